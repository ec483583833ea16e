"""Subpackage of spanloom."""
