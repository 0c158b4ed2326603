"""Operators on duplicate records and on text; nothing outside this package imports it."""
