"""Training-data operators: sharding, deduplication, scoring, decontamination, mixing."""
