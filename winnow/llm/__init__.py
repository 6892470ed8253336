"""Operators for large text corpora: sharding, de-duplication, filters, mixing, counts."""
