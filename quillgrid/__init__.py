"""A PySpark-native engine for knowledge bases and question banks."""

__version__ = "0.1.0"
