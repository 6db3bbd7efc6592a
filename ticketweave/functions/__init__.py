"""Column expressions for text and term vectors."""
