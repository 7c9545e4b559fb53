"""Spark-first text analytics over periodical archives."""
