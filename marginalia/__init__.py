"""Spark-first engine for document-grounded retrieval and assessment data."""
