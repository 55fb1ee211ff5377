"""Operators for large text corpora (deduplication, language, packing, quality, PII, ...)."""
