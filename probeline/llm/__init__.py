"""Operators of a large-scale training-data pipeline.

Nothing outside this subpackage imports it.  ``queries.py`` holds the thin
``opN_<name>`` queries and their SQL; every other module holds one operator
with its general interface.
"""
