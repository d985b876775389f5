"""Training-data operators: sharding, near-duplicates, quality, mixing, packing, filters, decontamination.

Nothing outside this subpackage imports it; ``queries`` lists the registered queries.
"""
