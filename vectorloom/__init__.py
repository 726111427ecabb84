"""vectorloom: a Spark-native engine for vectors with JSON payloads."""

__version__ = "0.1.0"
