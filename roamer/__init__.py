"""Roamer: mobility analytics and corpus preparation on Spark DataFrames."""
