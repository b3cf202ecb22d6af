"""Readers and writers of tables and text formats."""
