"""Evidence-catalog analytics on Spark DataFrames."""
