"""Training-data operators: tokenisation, quality, near duplicates, search, packing, extraction."""
