"""Operators of a training-data pipeline: fingerprints, scoring, packing, line and document dedup,
extraction, quality, sharding and tokenizing. Nothing else in the library imports this package."""
