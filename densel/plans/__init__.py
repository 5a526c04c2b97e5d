"""Registered queries (catalog), their DuckDB restatements (oracle) and the derived fixtures."""
