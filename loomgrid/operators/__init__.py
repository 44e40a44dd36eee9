"""Relational and spatial operators: DataFrames in, DataFrames out."""
