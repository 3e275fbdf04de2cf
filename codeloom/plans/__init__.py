"""Composed plans: tool queries and the catalog of registered queries."""
