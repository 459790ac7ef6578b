r"""Byte-level BPE by monoid tree reduction.

A text is encoded in halves, recursively; leaves go to tiktoken.  Two neighbours are joined by encoding a window around
their border again.  The window grows on each side until it starts and ends where white space follows something else:
no match of the pattern holds such a place inside (a match has white space at its start only, or nothing else), so
matches outside the window are those of the whole text, and so are their tokens.  Decoding concatenates up the same tree.

A null text counts as empty and has no tokens.  Repeated rows give repeated results; columns other than doc_id and text
are not read.  The vocabulary file is a parameter, which executors open at the same path.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession

from ._common import table

VOCAB = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
LEAF, IDS = 512, 1024  # code points and tokens below which a text is not halved
_BORDER = regex.compile(r"(?<=\S)\s")


class Codec:
    """Tokens of a rank file and a pattern."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}
        self.plain = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes[i] = token
        self.joins = 0  # so far
        self.decimal = [str(i) for i in range(len(self.bytes))]

    def encode(self, text: str, leaf: int = LEAF) -> list[int]:
        return self._half(text, 0, len(text), leaf)

    def _half(self, text: str, lo: int, hi: int, leaf: int) -> list[int]:
        if hi - lo <= leaf:
            return self.plain(text[lo:hi] if (lo, hi) != (0, len(text)) else text)
        mid = (lo + hi) // 2
        return self.join(text, lo, mid, hi, self._half(text, lo, mid, leaf), self._half(text, mid, hi, leaf))

    def join(self, text: str, lo: int, mid: int, hi: int, left: list[int], right: list[int]) -> list[int]:
        """The tokens of text[lo:hi] from those of text[lo:mid] and text[mid:hi]; ``left`` may be changed."""
        a, b = self._before(text, lo, mid), self._after(text, mid, hi)
        self.joins += 1
        drop = len(text[a:mid].encode())
        keep = len(left)
        while drop > 0:
            keep -= 1
            drop -= len(self.bytes[left[keep]])
        drop2, skip = len(text[mid:b].encode()), 0
        while drop2 > 0:
            drop2 -= len(self.bytes[right[skip]])
            skip += 1
        if drop or drop2:
            raise AssertionError("a window's end is inside a token")
        del left[keep:]
        left += self.plain(text[a:b])
        left += right[skip:] if skip else right
        return left

    @staticmethod
    def _before(text: str, lo: int, mid: int) -> int:
        size = 16
        while True:
            start = max(lo, mid - size)
            found = None
            for m in _BORDER.finditer(text, start, mid):
                if m.start() > lo:
                    found = m.start()
            if found is not None:
                return found
            if start == lo:
                return lo
            size *= 2

    @staticmethod
    def _after(text: str, mid: int, hi: int) -> int:
        size = 16
        while True:
            end = min(hi, mid + size)
            if m := _BORDER.search(text, mid + 1, end):
                return m.start()
            if end == hi:
                return hi
            size *= 2

    def decode(self, ids: list[int], leaf: int = IDS) -> bytes:
        if len(ids) <= leaf:
            table_ = self.bytes
            return b"".join([table_[i] for i in ids])
        mid = len(ids) // 2
        return self.decode(ids[:mid], leaf) + self.decode(ids[mid:], leaf)


@lru_cache(4)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_column(docs: DataFrame, path: str = VOCAB, leaf: int = LEAF) -> DataFrame:
    """(doc_id, ids array<int>) of each whole text."""

    def run(batches):
        c = codec(path)
        for b in batches:
            ids = [c.encode(t or "", leaf) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_column(encoded: DataFrame, path: str = VOCAB) -> DataFrame:
    """(doc_id, data binary) from (doc_id, ids); null ids give null."""

    def run(batches):
        c = codec(path)
        for b in batches:
            data = [None if x is None else c.decode(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(data, pa.binary())], names=["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def round_trip(docs: DataFrame, path: str = VOCAB, leaf: int = LEAF) -> DataFrame:
    """Digests of the ids of each whole text and of the bytes they decode to; n_joins counts the tree's joins."""

    def run(batches):
        c = codec(path)
        decimal = c.decimal
        for b in batches:
            for i in range(0, len(b), 256):
                part = b.slice(i, 256)
                n, ids_sha, text_sha, joins = [], [], [], []
                for t in part.column(1).to_pylist():
                    before = c.joins
                    ids = c.encode(t or "", leaf)
                    joins.append(c.joins - before)
                    n.append(len(ids))
                    ids_sha.append(hashlib.sha256(",".join([decimal[x] for x in ids]).encode()).hexdigest())
                    text_sha.append(hashlib.sha256(c.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string()), pa.array(joins, pa.int64())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_joins"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_joins long")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))


QUERIES = {"op7_bpe": op7_bpe}
ORACLE: dict[str, str] = {}
