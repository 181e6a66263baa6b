"""Training-data operators: language, quality and toxicity scores, deduplication, PII, BPE, packing, search, URL filters."""
