"""Labelled sparse two-dimensional tables on Spark DataFrames."""

__version__ = "0.1.0"
