"""Training-data operators: deduplication, filtering, scoring, archiving and mixing.

Nothing else in the library imports this subpackage.
"""
