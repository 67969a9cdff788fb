"""Incremental operators, circuits and SQL views."""
