"""Operators of a training-data pipeline: personal data, near duplicates, packing, repeated
passages, token files, secrets, web archives, quality rules, main text and benchmark leaks.

Nothing else in the library imports this subpackage.
"""
