"""Column expressions: times and texts."""
