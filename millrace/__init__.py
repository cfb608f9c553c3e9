"""PySpark-native engine for semi-structured records and text."""

__version__ = "0.1.0"
