"""Composite user-facing queries and their SQL oracles."""
