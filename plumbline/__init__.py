"""Plumbline: curate record sets and measure generated ones, on Spark DataFrames."""
