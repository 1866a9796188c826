"""spanloom: a PySpark-native analytics engine over traces of AI workflow runs."""

__version__ = "0.1.0"
