"""Sparse count analytics, expressed as Spark DataFrame plans."""
