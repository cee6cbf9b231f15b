"""Cost-balanced spatial partitioning on Spark DataFrames."""
