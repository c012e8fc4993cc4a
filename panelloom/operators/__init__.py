"""Operators on panels: each takes and returns DataFrames."""
