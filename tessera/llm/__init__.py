"""Training-data operators: extraction, deduplication, filtering, mixing.

Nothing else in the library imports this subpackage.
"""
