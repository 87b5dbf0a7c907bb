"""Spark-native analytics for numbered-draw data."""
