"""Readers of raw filing data and writers of results."""
