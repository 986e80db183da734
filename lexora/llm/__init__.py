"""Training-data operators: deduplication, token output, sharding, quality,
joins, search, personal data, language, BPE and mixing.

Nothing else in the library imports this subpackage.
"""
