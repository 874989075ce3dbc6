"""Operators for preparing training corpora: dedup, mixing, packing, filtering.

Nothing else in the library imports this subpackage.
"""
