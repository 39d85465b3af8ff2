"""tidegrid: a PySpark-native analytical data engine (DataFrame first)."""

__version__ = "0.1.0"
