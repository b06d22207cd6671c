"""Whole pipelines and the named queries of the library."""
