"""Operators of a training-data pipeline (tokens, deduplication, secrets,
nearest neighbours, fingerprints, quality, packing, sharding) as Spark jobs."""
