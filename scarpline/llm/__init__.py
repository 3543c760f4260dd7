"""Operators for preparing text corpora: each takes and returns DataFrames.

Nothing else in the library imports this subpackage.
"""
