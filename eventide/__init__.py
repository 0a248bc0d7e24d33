"""Eventide: point-in-time event studies on Spark DataFrames."""
