"""Retrieval-style data processing on Spark: DataFrame in, DataFrame out."""
