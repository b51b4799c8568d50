"""loomnote: note search, link graph and similarity on Spark DataFrames."""
