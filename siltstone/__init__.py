"""Siltstone: a relational and training-data engine declared on Spark."""
