"""Training-data operators: cleaning, deduplication, decontamination, formatting and packing of text corpora.

Nothing else in the library imports this subpackage.
"""
