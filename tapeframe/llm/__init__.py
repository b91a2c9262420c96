"""Operators for preparing training text: search, scanning, deduplication, scoring, encoding."""
