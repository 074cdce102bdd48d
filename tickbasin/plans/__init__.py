"""Guards and the SQL workbench."""
