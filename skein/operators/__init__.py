"""Relational and table-level operators."""
