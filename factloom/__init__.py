"""factloom: knowledge-graph memory analytics on Spark DataFrames."""
