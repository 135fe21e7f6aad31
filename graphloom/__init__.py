"""graphloom: source-code property-graph analytics on Apache Spark DataFrames."""
