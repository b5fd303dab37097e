"""codeweft: code-graph, text and training-data analytics on Spark DataFrames."""
