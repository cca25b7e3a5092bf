"""Spark-native analytics for benchmarking models on biological sequences."""
