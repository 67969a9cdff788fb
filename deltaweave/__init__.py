"""Incremental analytics on Spark: weighted tables, delta rules and maintained views."""
