"""The time-dependent operators over arriving data."""
