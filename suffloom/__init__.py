"""Suffix-index construction and full-text analytics on Spark DataFrames."""
