"""Metrics, policy, guarded SQL, currency lineage and combination."""
