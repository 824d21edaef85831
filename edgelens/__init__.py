"""Spark-native analytics over web-edge telemetry."""

__version__ = "0.1.0"
