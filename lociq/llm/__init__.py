"""Operators for preparing training text: scoring, filtering, deduplication, tokens and packing.

Nothing else in the library imports this subpackage.
"""
