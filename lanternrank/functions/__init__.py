"""Column expressions: they take and return ``Column`` and move no rows."""
