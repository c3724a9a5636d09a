"""Queries over graph collections."""
