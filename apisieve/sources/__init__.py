"""Scans, readers and writers."""
