"""Checks of item-to-profile assignments across two sources, on Spark DataFrames."""
