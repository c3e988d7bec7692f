"""Relational analysis of image regions on Spark DataFrames."""
