"""Operators of a training-data pipeline: deduplication, quality, language, sharding, packing, search, tokens.

Nothing outside this subpackage imports it.
"""
