"""Training-data operators: packing, archives, scoring, tokens, extraction, deduplication, media.

Nothing outside this package imports it.
"""
