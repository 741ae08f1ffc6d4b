"""Moment ranking on Spark: DataFrames in, DataFrames out."""
