"""Media-intelligence analytics on Spark DataFrames."""
