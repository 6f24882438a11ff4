"""Training-data operators: deduplication, filtering, formatting, fingerprints, sharding, packing and token files."""
