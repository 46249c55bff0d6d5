"""Training-data operators: filtering, deduplication, mixing, packing, tokenising and extraction."""
