"""Hybrid memory retrieval on Spark DataFrames."""
