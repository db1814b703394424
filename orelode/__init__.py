"""Spark-native forensics engine for content-addressed object stores."""

__version__ = "0.1.0"
