"""Sources: row indices, existing tables, schemas and configurations."""
