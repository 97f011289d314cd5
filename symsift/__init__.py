"""Spark-native analytics over symbol-occurrence tables."""
__version__ = "0.2.0"
