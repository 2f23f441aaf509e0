"""Training-data operators: token counting, deduplication, packing, archives, quality, toxicity, decontamination, sharding."""
