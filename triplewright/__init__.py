"""Document-to-triple analytics on Spark DataFrames."""
