"""Inspection analytics for trunk pipelines, written on Spark DataFrames."""
