"""Operators for preparing training text: formatting, deduplication, language, tokens, packing, search."""
