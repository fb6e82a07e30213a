"""Spark-native analytics for document retrieval: ingestion, hybrid search, evaluation and upkeep."""
