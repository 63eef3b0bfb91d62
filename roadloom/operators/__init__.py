"""Operators on networks given as DataFrames."""
