"""Relational operators over catalogs and structure tables."""
