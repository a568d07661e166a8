"""Operators for preparing large text corpora and vector collections.

Nothing outside this package imports it, and it imports nothing from the rest of the library.
"""
