"""Admission of concurrent work. There is no streaming over data in this engine; what runs at once are calls."""
