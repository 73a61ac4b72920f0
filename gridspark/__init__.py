"""Dense numeric analytics on Spark DataFrames."""
