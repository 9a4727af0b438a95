"""Conformance analytics over event logs and process models, as Spark DataFrames."""
