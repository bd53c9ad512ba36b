"""Queries and whole chains of operators."""
