"""graphloom: knowledge-graph analytics on Spark DataFrames."""
