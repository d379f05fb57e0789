"""Training-data operators: deduplication, packing, tokenising, formatting, search and scanning."""
