"""Operators for large training corpora: search, deduplication, extraction, filters, packing, output."""
