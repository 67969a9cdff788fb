"""Streams over logical time, and Structured Streaming drivers."""
