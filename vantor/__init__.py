"""Vector collections and corpus processing on PySpark."""

__version__ = "0.1.0"
