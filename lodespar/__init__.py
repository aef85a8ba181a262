"""Lodespar: an analytics engine on PySpark DataFrames, Spark SQL and Structured Streaming."""
