"""quern: a PySpark-native engine for reports, judgments and news feeds."""

__version__ = "0.1.0"
