"""Readers and the markup parse stage."""
