"""Operators for preparing language-model training corpora.

Nothing outside this package imports it.  Every operator is a function from
DataFrames to DataFrames; ``queries`` holds the thin registered queries.
"""
