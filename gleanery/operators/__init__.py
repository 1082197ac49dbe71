"""Queries' building blocks: DataFrames in, DataFrames out."""
