"""Readers and writers for tables and text corpora."""
