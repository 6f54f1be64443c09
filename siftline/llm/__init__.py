"""Operators that a large-scale training-data pipeline needs; nothing outside this package imports it."""
