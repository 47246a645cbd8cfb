"""Operators over lines, entries, cluster tables and records."""
