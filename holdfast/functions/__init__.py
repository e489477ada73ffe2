"""Column expressions: paths, hashes, escapes."""
