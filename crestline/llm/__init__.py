"""Operators for large training-data pipelines, and the queries that apply them.

Every operator is a function from DataFrames to DataFrames in a module of its
own; ``registry`` holds the registered queries and their SQL.
"""
