"""Training-data operators: filtering, deduplication, tokenising, packing, search."""
