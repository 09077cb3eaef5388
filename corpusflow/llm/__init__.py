"""Training-data operators: dedup, near-duplicate joins, toxicity, secrets, sharding, packing, mixing and vector search."""
