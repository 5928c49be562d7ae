"""Operators: each takes DataFrames (or columns) and returns lazy DataFrames."""
