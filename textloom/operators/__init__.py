"""Operators on DataFrames of documents."""
