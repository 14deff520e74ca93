"""Spark jobs that find, redact, count and score personal data in large text tables."""
