"""Operators for building training corpora: counting, mixing, search,
near-duplicate joins, packing, language ID, record files, WARC and URL filters.

Every module takes and returns DataFrames. Nothing outside this subpackage
imports it; it can be removed as a whole.
"""
