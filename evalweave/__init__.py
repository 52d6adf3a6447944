"""evalweave: a PySpark-native engine for evaluation data of code-generating models."""

__version__ = "0.1.0"
