"""Reusable DataFrame operators. Column names are parameters with plain defaults."""
