"""Operators for preparing large text corpora (ten operators and their queries)."""
