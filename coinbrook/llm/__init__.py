"""Operators for preparing training text: deduplication, filters, scoring, archives, extraction.

Nothing else in the package imports this subpackage.
"""
