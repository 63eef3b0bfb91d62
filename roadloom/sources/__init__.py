"""Readers and writers of network files."""
