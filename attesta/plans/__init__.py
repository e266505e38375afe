"""Registered queries: whole jobs over the given tables, each with its check in SQL."""
