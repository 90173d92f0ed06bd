"""Spark-native evidence analytics: typed evidence, claim tracing, run logs and corpus preparation."""

__version__ = "0.1.0"
