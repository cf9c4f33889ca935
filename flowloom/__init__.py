"""Data-integration operators as lazy Spark DataFrames with named output flows."""
