"""Operators of a training-data pipeline: dedup, search, archives, sharding, scoring, packing, token files, mixing."""
