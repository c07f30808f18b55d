"""terraweave: a PySpark-native engine for harmonising multi-source land and building records."""

__version__ = "0.1.0"
