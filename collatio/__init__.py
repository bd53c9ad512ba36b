"""Collation and analysis of text witnesses on Spark DataFrames."""
