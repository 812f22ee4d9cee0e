"""basketry: a PySpark-native analytics engine for two-table retail event logs."""

__version__ = "0.1.0"
