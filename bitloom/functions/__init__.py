"""Column expressions on packed words."""
