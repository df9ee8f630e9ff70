"""Training-data operators: scoring, scanning, deduplication, search, tokens and packing."""
