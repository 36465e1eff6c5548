"""Training-data operators: packing, mixing, sharding, search, deduplication, and text screening.

Nothing outside this subpackage imports it; ``queries.py`` registers its queries.
"""
