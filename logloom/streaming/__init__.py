"""The operators over streams that do not end."""
