"""A PySpark-native analytics engine for personalised content streams."""

__version__ = "0.1.0"
