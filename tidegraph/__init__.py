"""tidegraph: typed entity-graph analytics on Spark DataFrames."""
