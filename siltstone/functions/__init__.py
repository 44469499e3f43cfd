"""Scalar, aggregate, window and table functions as Column expressions."""
