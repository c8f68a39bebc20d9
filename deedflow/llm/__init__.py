"""Training-data operators: mixing, toxicity, quality, near-duplicates, sharding, archives, fingerprints, passages, packing, language.

Nothing else in the library imports this subpackage.
"""
