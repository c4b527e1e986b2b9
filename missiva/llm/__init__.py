"""Training-data operators: cleaning, mixing, deduplication, packing, formatting, search, archiving and scoring.

Nothing else in the library imports this subpackage.
"""
