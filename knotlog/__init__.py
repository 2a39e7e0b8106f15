"""Spark-native analytics over a versioned, graph-shaped knowledge log."""
