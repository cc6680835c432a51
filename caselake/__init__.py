"""Evidence-catalog analytics on Spark DataFrames and streams."""
