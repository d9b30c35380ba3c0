"""Training-data operators: packing, dedup, encoding, scoring and mixing, each over whole tables."""
