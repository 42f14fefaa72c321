"""Operators for preparing training text: formatting, duplicates, scoring, packing, extraction."""
