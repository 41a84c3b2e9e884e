"""Composite queries and the catalogue of registered queries."""
