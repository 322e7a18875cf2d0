"""Training-data operators: quality, near-duplicates, secrets, packing, toxicity, lines, search and token files."""
