"""Operators and queries for preparing text collections used to train language models.

Nothing else in the library imports this subpackage.
"""
