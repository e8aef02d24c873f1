"""Spark-native corpus retrieval, memory governance and analytics operators."""
