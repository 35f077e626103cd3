"""Operators for preparing training data: filtering, extraction, joins, packing, tokens, search and sharding."""
