"""Training-data operators: mixing, search, filters, dedup, sharding, tokens, extraction."""
