"""Streams of filings and snapshots."""
