"""Spark-native analytics for structured document extraction."""
