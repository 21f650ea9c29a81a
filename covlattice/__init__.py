"""Coverage-geometry analytics on Spark DataFrames."""
