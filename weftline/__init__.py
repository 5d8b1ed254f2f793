"""Spark-native analytics over code-contract graphs."""

__version__ = "0.1.0"
