"""Operators for preparing training text at scale (personal data, secrets, fixity, deduplication, quality, licences, tokens)."""
