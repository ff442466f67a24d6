"""quire: document structuring and retrieval analytics on Spark DataFrames."""
