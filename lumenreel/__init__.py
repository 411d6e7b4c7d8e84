"""Media library analytics on Spark DataFrames."""
