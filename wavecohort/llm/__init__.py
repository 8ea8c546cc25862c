"""Operators of a training-data pipeline: deduplication, scans, mixing, sharding, token files.

Nothing else in the library imports this subpackage.  Every operator takes and
returns DataFrames; ``queries`` holds the registered queries.
"""
