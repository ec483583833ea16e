"""Operators for very large training-data tables; nothing outside this subpackage imports it."""
