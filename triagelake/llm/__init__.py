"""Operators for preparing training text: quality, duplicates, leaks, mixing, licenses, counts, toxicity."""
