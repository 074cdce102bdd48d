"""Operators on the six datasets."""
