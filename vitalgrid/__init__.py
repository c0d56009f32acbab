"""Spark-native analytics for wearable-sensor data, in batch and as streams."""

__version__ = "0.1.0"
