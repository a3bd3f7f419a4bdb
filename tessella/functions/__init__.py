"""Scalar and aggregate functions as Spark columns."""
