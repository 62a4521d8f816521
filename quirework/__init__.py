"""A document-structure engine on Spark DataFrames."""
