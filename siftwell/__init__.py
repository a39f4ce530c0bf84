"""Batch curation of measured records on Spark DataFrames."""
