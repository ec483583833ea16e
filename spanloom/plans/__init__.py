"""Registered queries, one module a family."""
