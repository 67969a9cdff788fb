"""Weighted tables and their batch operators."""
