"""Operators on DataFrames of records, results and taxonomy."""
