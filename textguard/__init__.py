"""Sensitive-text detection and redaction as PySpark DataFrame jobs."""

__version__ = "0.1.0"
