"""Operators of a training-data pipeline: dedup, language, quality, personal data, tokens, packing.

Nothing outside this folder imports it.
"""
