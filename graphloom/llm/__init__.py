"""Training-data operators: deduplication, filtering, extraction and tokenisation of document tables.

Nothing else in the library imports this subpackage.
"""
