"""Spark-native single-cell and spatial analytics."""
