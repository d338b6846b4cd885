"""Operators that a training-data pipeline over text needs.

Nothing outside this package imports it.  Every operator takes DataFrames with
the columns it names (others are ignored) and returns a lazy DataFrame.
"""
