"""Training-data operators: scoring, deduplication, extraction, archives and packing.

Nothing else in the library imports this subpackage.
"""
