"""Training-data operators: toxicity, near-duplicates, packing, token counts, quality, mixing, search, licences, secrets.

Nothing else in the library imports this subpackage; it may be deleted as a whole.
"""
