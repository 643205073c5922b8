"""Flows made of several operators."""
