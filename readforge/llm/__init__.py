"""Operators for large-scale training-data preparation, built on Spark DataFrames."""
