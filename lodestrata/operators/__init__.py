"""Operators on batches, columns and dictionaries."""
