"""Nearfield: vector search and analytics over Spark DataFrames."""
