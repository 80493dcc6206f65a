"""Lowering of planned queries to DataFrames."""
