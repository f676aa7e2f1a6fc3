"""Point-in-time rate analytics and hybrid document retrieval on Spark DataFrames."""
