"""Reusable DataFrame operators. Each takes DataFrames and column names and returns a
lazy DataFrame; none collects rows to the driver or uses a Python UDF."""
