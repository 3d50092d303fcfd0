"""Document, JSON and vector processing on Spark DataFrames."""
