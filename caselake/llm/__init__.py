"""Training-data operators: deduplication, filtering, packing, mixing and sharding.

Nothing else in the library imports this subpackage.
"""
