"""Relational and order-dependent operators: DataFrames in, DataFrames out."""
