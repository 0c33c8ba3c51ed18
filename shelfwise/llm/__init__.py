"""Training-data operators: deduplication, filtering, sharding and packing of text."""
