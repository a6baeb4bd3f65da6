"""Spark jobs over a corpus of sports game reports, and operators for training data."""
