"""Operators over rows: assignment of parents, validation, hierarchies, reports."""
