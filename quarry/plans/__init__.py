"""Composed pipelines and the registry of named queries."""
