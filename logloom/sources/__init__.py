"""Readers of lines and of records of declared formats."""
