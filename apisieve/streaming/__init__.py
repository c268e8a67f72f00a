"""Incremental usage counts over streams."""
