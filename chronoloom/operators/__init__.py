"""Operators over commit-history tables: DataFrames in, DataFrames out."""
