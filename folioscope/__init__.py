"""Find the documents worth reading in a large corpus, on Spark DataFrames."""
