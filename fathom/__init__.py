"""Dataset insight as plain functions from DataFrames to DataFrames."""
