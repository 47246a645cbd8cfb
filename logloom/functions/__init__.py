"""Scalar functions, as Columns where Spark can express them."""
