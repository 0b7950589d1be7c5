"""Training-data operators: packing, extraction, scanning, mixing, deduplication, search, language ID and media."""
