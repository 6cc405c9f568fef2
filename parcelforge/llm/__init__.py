"""Operators for training-data pipelines that work on language; nothing else in the library imports this package."""
