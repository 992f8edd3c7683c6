"""Spark-native analytics over n-dimensional numeric data and record datasets."""

__version__ = "0.1.0"
