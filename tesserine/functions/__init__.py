"""Column functions: text, markdown, vectors."""
