"""Readers, writers, table views and slices."""
