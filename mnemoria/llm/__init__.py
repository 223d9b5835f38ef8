"""Training-data operators: mixing, scans, quality, dedup, sharding, search, packing.

Nothing else in the library imports this subpackage.
"""
