"""Training-data operators: dedup, scans, sharding, scoring, packing and rules for text corpora."""
