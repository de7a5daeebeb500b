"""Operators for training-data pipelines.

Nothing outside this folder imports it. ``registry`` holds the queries and
their DuckDB statements.
"""
