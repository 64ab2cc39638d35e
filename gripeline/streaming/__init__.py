"""Incremental runs (an extension: the analytics themselves are batch)."""
