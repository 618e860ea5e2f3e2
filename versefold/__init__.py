"""Spark-native analytics for annotated text corpora and product catalogues."""

__version__ = "0.1.0"
