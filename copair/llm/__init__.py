"""Operators for large training-data pipelines.

Each module is one operator with its own DataFrame interface; ``queries.py``
holds the thin ``opN_<name>`` queries over the given tables.  Nothing outside
this subpackage imports it.
"""
