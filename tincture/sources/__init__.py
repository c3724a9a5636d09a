"""Readers of graph collections, run logs and in-memory edges."""
