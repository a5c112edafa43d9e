"""A document corpus engine on Spark DataFrames."""
