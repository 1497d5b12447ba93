"""Sound-library analytics and corpus preparation on Spark DataFrames."""
