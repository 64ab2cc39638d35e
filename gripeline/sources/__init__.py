"""Readers and producers of the input tables."""
