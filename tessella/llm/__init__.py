"""Operators for preparing training data, one module each.

Nothing outside this subpackage imports it; ``queries.py`` registers the
queries and their SQL.
"""
