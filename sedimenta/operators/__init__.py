"""Operators: pure functions of DataFrames, parameterised by column names."""
