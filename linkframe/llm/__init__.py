"""Operators for building training data from text. Nothing else in the library imports this package."""
