"""Structural-biology feature analytics and training-data preparation on Spark DataFrames."""
