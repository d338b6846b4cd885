"""Spark-native analytics for music libraries held as tables."""
