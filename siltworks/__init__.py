"""Spark-native log, code-evidence and corpus analytics."""

__version__ = "0.1.0"
