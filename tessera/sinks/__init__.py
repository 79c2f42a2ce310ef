"""Sinks: CSV, JSON and SQL text."""
