"""Operators for preparing training text: duplicates, personal data, extraction, scores, tokens."""
