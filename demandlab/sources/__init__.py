"""Readers for tables, files and literal lookups; writers (sinks)."""

from demandlab.sources.tables import Tables, read_table, read_sql, use_database, strip_column_prefix  # noqa: F401
