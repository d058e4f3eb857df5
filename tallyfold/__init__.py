"""Spark jobs for financial panel and time-series data on long DataFrames."""
