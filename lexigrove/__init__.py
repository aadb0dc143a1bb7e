"""lexigrove: retrieval-style question answering over document collections, on Spark DataFrames."""
