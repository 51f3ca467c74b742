"""Training-data operators: deduplication, decontamination, quality, mixing, extraction.

Nothing outside this subpackage imports it.  Every operator takes DataFrames and
returns a DataFrame; ``queries`` holds the thin registered queries on top.
"""
