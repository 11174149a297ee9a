"""Labelled-pair analytics on Spark DataFrames."""
