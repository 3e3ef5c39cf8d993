"""Operators for preparing training data: near duplicates, extraction, counts, quality, packing, mixing, toxicity."""
