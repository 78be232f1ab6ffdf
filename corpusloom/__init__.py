"""Sequence and text analytics on Spark DataFrames."""
