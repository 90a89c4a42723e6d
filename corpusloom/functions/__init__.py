"""Column-level helpers: text, vectors, paths."""
