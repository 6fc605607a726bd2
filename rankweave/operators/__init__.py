"""Distributed operators: ranking, splitting, placing, sorting and checking DataFrames."""
