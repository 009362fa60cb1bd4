"""Readers, writers and table-level checks."""
