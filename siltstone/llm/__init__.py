"""Operators of a training-data pipeline over the documents table. Nothing else in the library imports this package."""
