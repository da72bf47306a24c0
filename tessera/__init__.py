"""Spark-native analytics over embedding collections with positions in an image pyramid."""
