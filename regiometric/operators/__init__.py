"""Operators: each takes DataFrames and column names and returns lazy DataFrames."""
