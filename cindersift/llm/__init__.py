"""Operators for preparing large text corpora: scans, filters, de-duplication, mixing, formatting.

Nothing outside this subpackage imports it.
"""
