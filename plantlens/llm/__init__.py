"""Operators for building training data: packing, formatting, token files, deduplication, filters and shards."""
