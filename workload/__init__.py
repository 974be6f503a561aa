"""The registered queries, the tables they run on, and their DuckDB equivalents."""
