"""Column expressions and shared ordering helpers."""
