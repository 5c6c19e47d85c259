"""Training-data operators: deduplication, filtering, scoring, tokenising and packing of documents."""
