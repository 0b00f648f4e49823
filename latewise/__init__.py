"""Delay-prediction analytics on Spark DataFrames."""
