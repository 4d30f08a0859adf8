"""Incremental forms of the two append-only feeds."""
