"""Spark-native chunk indexing, semantic and keyword search, and corpus analytics."""
