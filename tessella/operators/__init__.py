"""Operators on frames beyond single functions."""
