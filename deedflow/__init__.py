"""Corpus analytics for contracts and similar documents, on Spark DataFrames."""
