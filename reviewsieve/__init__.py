"""Document-screening analytics on Spark: DataFrames in, DataFrames out."""
