"""Source-graph and versioned-knowledge analytics expressed in Spark SQL and DataFrames."""
