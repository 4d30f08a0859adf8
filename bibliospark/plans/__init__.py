"""Registered queries: each operator over the driver's tables, beside its SQL."""
