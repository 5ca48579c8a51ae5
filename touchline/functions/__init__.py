"""Column expressions and sequence helpers."""
