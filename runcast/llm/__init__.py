"""Operators for training-data pipelines, one module per operator, each taking and giving DataFrames."""
