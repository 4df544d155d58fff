"""Readers, writers and views of recordings."""
