"""Readers, writers and the relation catalog."""
