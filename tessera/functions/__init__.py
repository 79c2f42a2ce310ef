"""Column expressions: deterministic draws and value generators."""
