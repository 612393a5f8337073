"""Column builders: null-safe arithmetic, dates, and the forensic models."""
