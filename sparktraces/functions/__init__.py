"""Column expressions: labels, physics and derived measures."""
