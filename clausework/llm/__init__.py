"""Training-data operators: deduplication, sharding, tokenizing, mixing, media, toxicity and chat formatting.

Nothing outside this subpackage imports it.
"""
