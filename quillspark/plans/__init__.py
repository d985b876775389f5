"""Composed queries, the search pipeline and the catalogue with its SQL."""
