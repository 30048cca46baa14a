"""Column expressions and table-wide ranking helpers."""
