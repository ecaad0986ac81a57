"""Spark-first analytics for identity documents: reading, classifying, extracting,
validating and scoring many documents at once with DataFrame operations."""

__version__ = "0.1.0"
