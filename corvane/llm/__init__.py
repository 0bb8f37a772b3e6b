"""Training-data operators: deduplication, filtering, scoring, packing and extraction."""
