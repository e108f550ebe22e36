"""Operators for large training-data pipelines: tokens, de-duplication, scoring, mixing, media.

Nothing outside this subpackage imports it.
"""
