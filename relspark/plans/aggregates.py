"""Aggregates as Spark SQL text, shared by the compiler and ``to_sql``."""

from __future__ import annotations


def aggregate_sql(a, name) -> str:
    """``name`` gives a column's text.  STDDEV of one value is 0; GEOMEAN skips zeros and is NaN with a negative value."""
    d = "DISTINCT " if a.distinct else ""
    if a.fn == "COUNT":
        return "count(1)" if not d and a.base.name == "*" else f"count({d}{name(a.base)})"
    c = name(a.base)
    if a.fn in ("SUM", "AVG", "MIN", "MAX"):
        return f"{a.fn.lower()}({d}{c})"
    if a.fn == "STDDEV":
        return f"CASE WHEN count({d}{c}) = 1 THEN 0.0D ELSE stddev_samp({d}{c}) END"
    if a.fn == "GEOMEAN":
        return f"CASE WHEN max({c} < 0) THEN double('NaN') ELSE exp(avg({d}CASE WHEN {c} > 0 THEN ln({c}) END)) END"
    raise ValueError(a.fn)
