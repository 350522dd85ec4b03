"""Readers, writers and page extraction."""
