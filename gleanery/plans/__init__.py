"""Queries by name, each with the SQL that says the same."""
