"""Corpus analytics on Spark: DataFrame operators for text corpora."""

__version__ = "0.1.0"
