"""Operators for training text and event sequences; nothing else in the library imports this package."""
