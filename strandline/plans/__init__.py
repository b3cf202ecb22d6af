"""Registered queries, their test views and SQL oracles."""
