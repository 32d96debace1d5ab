"""siltstone: a Spark-native text search, retrieval and change-processing engine."""

__version__ = "0.1.0"
