"""Orrery: vector-dataset and metadata analytics on Spark DataFrames."""
