"""Entity-resolution and record analytics on Spark DataFrames."""
