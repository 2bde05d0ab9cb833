"""Operators on corpora of texts; nothing else in the library imports this package."""
