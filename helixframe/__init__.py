"""Spark-native correction of noisy sequence reads and analytics over the result."""

__version__ = "0.1.0"
