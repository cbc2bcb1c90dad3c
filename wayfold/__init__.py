"""Wayfold: map-feature analytics on Spark DataFrames."""
