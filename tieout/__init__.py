"""tieout: a PySpark-native reconciliation engine for structured financial exports."""

__version__ = "0.1.0"
