"""Stability operators: each takes and gives DataFrames."""
