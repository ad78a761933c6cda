"""Readers and writers of recording, key map and matrix files."""
