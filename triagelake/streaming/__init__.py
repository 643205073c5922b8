"""The request endpoints as streaming tables."""
