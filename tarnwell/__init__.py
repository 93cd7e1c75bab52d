"""tarnwell: a PySpark-native engine for exploratory analytics and training-data work."""

__version__ = "0.1.0"
