"""Operators for preparing training text: quality, secrets, licences, mixing, extraction, search, near copies."""
