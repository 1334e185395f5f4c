"""Retrieval, evaluation and ingestion of document collections with Spark."""
