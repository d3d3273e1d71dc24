"""Training-data operators: deduplication, classifiers, packing, decontamination and extraction.

Nothing else in the library imports this subpackage. ``queries`` holds the registered queries.
"""
