"""Text-reuse analytics on Spark DataFrames."""
