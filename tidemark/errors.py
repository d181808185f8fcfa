"""Refusals with stable codes."""


class Refused(Exception):
    """A request that the engine does not carry out; code is stable, the message is for people."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code
