"""Training-data operators: deduplication, filtering, archives, attribution and mixing.

Nothing outside this subpackage imports it.
"""
