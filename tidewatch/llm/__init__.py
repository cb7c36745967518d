"""Operators for preparing training corpora (search, mixing, dedup, tokens, filters)."""
