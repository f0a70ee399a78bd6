"""Relational operators on readings. Each takes and returns lazy DataFrames."""
