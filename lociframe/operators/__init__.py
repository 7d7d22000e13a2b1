"""Operators on the data model, as lazily planned DataFrame functions."""
