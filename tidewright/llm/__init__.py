"""Training-data operators: archives, text quality, near-duplicates, sharding and packing.

Nothing outside this subpackage imports it; ``queries.QUERIES`` lists its queries.
"""
