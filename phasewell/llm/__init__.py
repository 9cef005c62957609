"""Operators for large-scale text and embedding corpora.

Nothing else in the library imports this subpackage; it can be removed whole.
"""
