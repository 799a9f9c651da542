"""Vocabulary and corpus analytics on Spark DataFrames."""
