"""Queries: the operators over relations derived from the star-schema tables."""
