"""Training-data operators: deduplication, filtering, fingerprints, mixing, formatting."""
