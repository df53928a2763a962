"""Spark-native analytics over discrete tables: counting, structure search, inference, sampling and table hygiene."""

__version__ = "0.1.0"
