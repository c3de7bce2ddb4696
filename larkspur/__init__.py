"""Larkspur: a PySpark-native analytics engine of composable DataFrame operators."""

__version__ = "0.1.0"
