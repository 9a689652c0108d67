"""A Spark-native engine for building, checking and analysing text-record datasets."""

__version__ = "0.1.0"
