"""Operators for training-data pipelines; see README.  Nothing outside imports this package."""
