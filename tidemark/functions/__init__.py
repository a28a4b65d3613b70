"""Column functions: text, vectors, distributions."""
