"""Operators for preparing text corpora as training data.

Nothing else in the package imports this subpackage; it can be removed whole.
"""
