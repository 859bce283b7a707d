"""Feed analytics, search and data refinement on Spark DataFrames."""
