"""Training-data operators: scoring, deduplication, extraction, mixing and packing of text corpora."""
