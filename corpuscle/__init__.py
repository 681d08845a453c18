"""corpuscle: document screening, retrieval, scoring and ranking over Spark DataFrames."""
