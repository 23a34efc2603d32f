"""Span analytics for text privacy, as Spark DataFrames."""

__version__ = "0.1.0"
