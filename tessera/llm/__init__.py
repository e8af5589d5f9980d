"""Training-data operators: quality, duplicates, contamination, privacy, mixing and sharding."""
