"""Queries and SQL of this subpackage, by key."""

from __future__ import annotations

from . import bpe, lm, media, mixing, neardup, secrets, topk, toxicity, urls, warc

MODULES = (topk, toxicity, urls, mixing, secrets, warc, bpe, media, lm, neardup)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: s for m in MODULES for k, s in m.ORACLE.items()}
