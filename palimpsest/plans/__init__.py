"""Queries end to end."""
