"""Training-data operators: ten Spark jobs over text, vectors and media columns."""
