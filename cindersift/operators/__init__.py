"""Relational operators: DataFrame in, DataFrame out, for all companies at once."""
