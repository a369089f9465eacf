"""Composed plans and the registry of queries."""
