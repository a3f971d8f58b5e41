"""Operators for large training corpora: sharding, mixing, deduplication, packing, archives, quality."""
