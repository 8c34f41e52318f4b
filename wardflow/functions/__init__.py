"""Column expressions. No Python runs per row."""
