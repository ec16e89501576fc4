"""Operators for large training corpora: sharding, redaction, filtering, deduplication, scoring and encoding."""
