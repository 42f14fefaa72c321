"""Structured Streaming jobs over the same transform as the batch ones."""
