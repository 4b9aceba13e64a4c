"""Spark-native mining and analytics engine (DataFrame API only)."""

__version__ = "0.1.0"
