"""Training-data operators: mixing, search, deduplication, scoring, decontamination and scans.

Nothing else in the library imports this subpackage.
"""
