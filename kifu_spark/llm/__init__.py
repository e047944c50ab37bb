"""Training-data operators: token counts, sharding, deduplication, search, classifiers, mixing, packing."""
