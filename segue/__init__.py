"""Spark-first analytics for curating large music libraries."""
