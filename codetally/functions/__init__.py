"""Column expressions: paths, lines, licence texts. All of them are built-ins."""
