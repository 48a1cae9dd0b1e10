"""loomgraph: reciprocal-reference graph analytics on Spark DataFrames."""
