"""Column expressions and argument rules; no Python runs per row."""
