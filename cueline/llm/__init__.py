"""Training-data operators: deduplication, mixing, sharding, quality, licences, counting and packing."""
