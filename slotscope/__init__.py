"""Compute-pool analytics on Spark DataFrames and Structured Streaming."""
