"""Relational synthesis and integrity checks on Spark DataFrames."""
