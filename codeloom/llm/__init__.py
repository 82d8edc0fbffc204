"""Training-data operators: deduplication, filtering, encoding and packing of documents."""
