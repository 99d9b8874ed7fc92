"""Training-data operators: mixing, deduplication, sharding, token files, decontamination, scoring."""
