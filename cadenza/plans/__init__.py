"""Queries with their bindings and oracles."""
