"""Composite plans over the bound test tables and the query registry."""
