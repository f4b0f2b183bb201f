"""Training-data operators: deduplication, decontamination, packing, search, scanning.

Nothing outside this subpackage imports it.  Each module holds one operator with a general
interface; ``catalog`` registers the queries and their SQL twins.
"""
