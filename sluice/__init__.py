"""Spark-native document and run analytics."""
