"""Contract and document analytics on Spark DataFrames."""
