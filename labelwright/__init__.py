"""Price-tag record analytics on Spark DataFrames."""
