"""Column expressions: geometry, hashing, user hooks."""
