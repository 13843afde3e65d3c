"""Unbounded feeds of page captures."""
