"""Operators of a training-data pipeline: mixing, search, quality, language, packing, deduplication and sharding."""
