"""Span-level likelihood analytics on Spark DataFrames."""
