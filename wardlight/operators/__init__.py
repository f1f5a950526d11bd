"""Relational and statistical operators; each returns a lazy DataFrame."""
