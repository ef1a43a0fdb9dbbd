"""Structural text analytics on Spark DataFrames."""
