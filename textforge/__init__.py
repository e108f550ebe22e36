"""Spark-native text retrieval, corpus analytics and training-data engine."""

__version__ = "0.1.0"
