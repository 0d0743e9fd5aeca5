"""Basalt: a PySpark-native engine for evidence, graph and trace analytics."""

__version__ = "0.1.0"
