"""Training-data operators: language id, packing, dedup, tokens, search, toxicity."""
