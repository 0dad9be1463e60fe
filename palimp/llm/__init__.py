"""Operators for training-data text pipelines."""
