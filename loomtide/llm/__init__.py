"""Operators for building training data: de-duplication, packing, search, filters and tokenisation.

Nothing else in the library imports this subpackage.
"""
