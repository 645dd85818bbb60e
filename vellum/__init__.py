"""Spark-first document analytics."""
