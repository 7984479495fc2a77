"""A nearest-neighbour engine on Spark DataFrames."""
