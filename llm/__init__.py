"""Operators for training-data pipelines, their queries and SQL twins. Nothing outside this package imports it."""
