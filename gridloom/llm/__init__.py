"""Training-data operators: deduplication, decontamination, classification, scanning, search, sharding, packing.

Nothing outside this subpackage imports it. Every module holds one operator with a general interface; ``queries``
holds the thin, registered queries that fix the production parameters and derive digest columns.
"""
