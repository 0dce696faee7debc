"""Training-data operators: output, quality, deduplication, packing, safety.

Nothing else in the library imports this subpackage.
"""
