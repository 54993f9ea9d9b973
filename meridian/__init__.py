"""Spark-native vector retrieval analytics."""
