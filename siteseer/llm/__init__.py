"""Operators of a large-scale training-data pipeline.

Nothing outside this package imports it.  Every operator takes and returns
DataFrames; ``registry`` holds the thin queries that bind them to tables.
"""
