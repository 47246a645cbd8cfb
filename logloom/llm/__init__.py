"""Operators for training data: frequent items, runs, encoding, leaks, look-alikes.

Nothing else in the library imports this package; the driver contract adds its queries
where it can be imported.
"""
