"""Operators of a training-data pipeline over a ``documents`` table.

Every module holds one operator: general functions over DataFrames plus a
thin registered query.  Nothing outside this subpackage imports it.
"""
