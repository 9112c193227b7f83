"""Quaystone: a PySpark-native analytics engine for partitioned star schemas of timestamped events."""

__version__ = "0.1.0"
