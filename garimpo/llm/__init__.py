"""Operators that prepare a collection of texts as training data."""
