"""Operators of a large-scale training-data pipeline, built on DataFrames.

Nothing else in the library imports this package.  ``queries`` holds the
registered queries and their SQL.
"""
