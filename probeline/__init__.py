"""A Spark engine for lookup joins and fixed-point analytics."""
