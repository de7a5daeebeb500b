"""Relational operators of the audit; each returns a lazy DataFrame."""
