"""Operators of the document-operations workload: DataFrames in, DataFrames out."""
