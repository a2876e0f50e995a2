"""Operators for preparing training data at large scale.

Every operator takes and returns DataFrames. Nothing else in the library
imports this package.
"""
