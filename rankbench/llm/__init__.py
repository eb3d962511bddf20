"""Operators for preparing training data: filters, deduplication, packing, mixing, sharding."""
