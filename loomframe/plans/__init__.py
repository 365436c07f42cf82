"""Named queries: each module has QUERIES (name to plan) and ORACLES (name to DuckDB SQL)."""
