"""Column-level functions: paths, text, globs and fixed values."""
