"""Topic-trend analytics on Spark DataFrames."""
