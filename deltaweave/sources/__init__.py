"""Keyed tables, change logs, schemas and generated deltas."""
