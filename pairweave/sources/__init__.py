"""Readers for pair tables, object lists and raw delimited records; the assignment writer."""
