"""Training-data operators: deduplication, quality, language, packing and media columns over a corpus."""
