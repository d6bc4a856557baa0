"""Sequence-corpus analytics on Spark DataFrames."""
