"""Lookup, join and partitioning operators."""
