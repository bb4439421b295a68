"""Readers of text formats and the archive on disk."""
