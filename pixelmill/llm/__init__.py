"""Training-data operators: filters, deduplication, search, mixing and packing for text corpora.

Nothing else in the library imports this subpackage; ``queries`` holds what the entry module registers.
"""
