"""Queries over the given tables: each binds operators to tables, with a SQL twin."""
