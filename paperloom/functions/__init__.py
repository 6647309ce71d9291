"""Column expressions: text, JSON, files, vectors."""
