"""Training-data operators: search, filters, mixing, scans, tokenizing, media, scoring, dedup.

Each module holds one operator with a general interface and, at its end, the thin query that
``__spark_entry__`` registers.  Nothing outside this package imports it.
"""
