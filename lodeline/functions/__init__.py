"""Column expressions: paths, visibility, labels."""
