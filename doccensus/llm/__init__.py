"""Operators for training-data corpora: duplicates, leaks, quality, licences, packing, token files, chat.

Nothing outside this subpackage imports it. Every operator takes and returns DataFrames; the queries that bind
them to the given tables are in the ``*_queries`` modules and gathered in ``registry``.
"""
