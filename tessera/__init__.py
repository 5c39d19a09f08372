"""Tessera: a PySpark-native engine for lexicometric text analytics."""

__version__ = "0.1.0"
