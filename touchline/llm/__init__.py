"""Training-data pipeline operators: sharding, deduplication, token counts, packing,
search, decontamination, quality and language-model scoring.

Nothing else in the library imports this subpackage.
"""
