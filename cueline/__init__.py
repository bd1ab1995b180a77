"""Timed-text analytics and training-data operators on Spark DataFrames."""
