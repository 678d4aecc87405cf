"""Stream-style analytics on Spark DataFrames."""
