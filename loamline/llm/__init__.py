"""Training-data operators: counting, scoring, deduplication, mixing and packing of document tables."""
