"""Typed object graphs, retrieval and workflow analytics on Spark DataFrames."""
