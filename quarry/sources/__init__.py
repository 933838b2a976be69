"""Readers and parsers that give source rows."""
