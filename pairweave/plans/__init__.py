"""Whole query plans: the clustering pipeline and the registered queries."""
