"""Registered queries: each operator applied to inputs derived from the given tables."""
