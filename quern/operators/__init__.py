"""Relational, ordered and array operators on Spark DataFrames."""
