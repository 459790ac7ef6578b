r"""Exact top-k search by inner product, with a pivot table.

Vectors become integers, floor(256 x).  For each candidate of a block the table holds its distances to many pivots.  They
fix the candidate's place c within the pivots' span and its distance r from that span, so that a query at (c', r') is at
least sqrt(|c - c'|^2 + (r - r')^2) away: the maximum lower bound that the distances allow.  As |q - x|^2 = |q|^2 + |x|^2 -
2 <q, x>, that is an upper bound of the score, c c' + r r'.  A query evaluates candidates in the order of their bounds and
stops when its k-th score is above all bounds left.  Bounds are rounded up past any float error.

Candidates come in blocks of about ``BLOCK_BYTES`` and a set of queries (here a stated one, a fiftieth of the rows) in
blocks as well; each pair of blocks is one group, and its winners are merged per query.  Pivots are rows of a sample of
``SAMPLE`` rows, each the farthest from the span of those before it; they steer speed only, never results.  How much the
bounds save depends on the data: ``evaluations`` counts it.

Scores are exact whole numbers: sums go by floats where all of them fit 53 bits, else by longs where they fit, else by
unlimited integers; a score beyond a long counts as the largest or least long, and so does a component.

Vectors that are null or hold null or non-finite components take no part; a vector meets only those of its length.
Rows with the query's own vec_id are no candidates; equal rows each count as candidates, and as one query (rows of one
vec_id with different vectors are queries of their own).  Equal scores go to the smaller vec_id.
Null ids take no part.  Columns other than vec_id and embedding are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import durable, table

SAMPLE, PIVOTS, SHARE = 1024, 128, 0.8  # of the dimensions at most
BLOCK_BYTES, BLOCK_ROWS = 16 << 20, 16384
LONG = (1 << 63) - 1


def integer_vectors(df: DataFrame, scale: float = 256.0) -> DataFrame:
    """(vec_id long, v array<int>) of the rows that take part."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    ok = df.select("vec_id", "embedding").filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad)
    return ok.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("v"))


def choose_pivots(vectors: DataFrame, pivots: int = PIVOTS) -> dict[int, np.ndarray]:
    """By vector length: rows of the sample, each the farthest from the span of those before it."""
    rows = vectors.select("v", F.xxhash64("vec_id").alias("h")).orderBy("h", "v").limit(SAMPLE).collect()
    out = {}
    for n in {len(r.v) for r in rows}:
        rest = x = np.array([r.v for r in rows if len(r.v) == n], np.float64).reshape(-1, n)
        kept: list[int] = []
        least = 1e-3 * np.sqrt((x * x).sum(1).max(initial=0))
        for _ in range(min(pivots, int(np.ceil(SHARE * n)), len(x))):
            off = np.sqrt((rest * rest).sum(1))
            at = int(off.argmax())
            if off[at] <= least:
                break
            kept.append(at)
            one = rest[at] / off[at]
            rest = rest - np.outer(rest @ one, one)
        out[n] = x[kept]
    return out


class PivotTable:
    """Candidates ``x`` (whole numbers) with their distances to pivots, in the form that bounds need."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, pivots: np.ndarray):
        self.ids, self.whole, self.x, self.pivots = ids, x, x.astype(np.float64), pivots
        self.most = int(np.abs(x).max(initial=0)) if not x.size or x.min() > -LONG else LONG + 1
        self.norms = (self.x * self.x).sum(1)
        self.base = np.linalg.qr(pivots.T)[1].T if len(pivots) else np.zeros((0, 0))  # pivots in coordinates of their span
        self.table = self.distances(self.x, self.norms)
        self.place, self.off = self._placed(self.table, self.norms)

    def distances(self, x: np.ndarray, norms: np.ndarray) -> np.ndarray:
        p = self.pivots
        return np.sqrt(np.maximum(0, norms + (p * p).sum(1)[:, None] - 2 * p @ x.T))

    def _placed(self, table_: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From distances to the pivots: coordinates in their span, and the distance from it."""
        products = (norms + (self.pivots**2).sum(1)[:, None] - table_**2) / 2
        place = np.linalg.solve(self.base, products).T if len(self.pivots) else np.zeros((len(norms), 0))
        return place, np.sqrt(np.maximum(0, norms - (place * place).sum(1)))

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """An upper bound of each query's score with each candidate."""
        norms = (q * q).sum(1)
        place, off = self._placed(self.distances(q, norms), norms)
        return place @ self.place.T + np.outer(off, self.off) + 1e-6 * (norms[:, None] + self.norms) + 1

    def scores(self, part: np.ndarray, q: np.ndarray, q_whole: list[int]) -> np.ndarray:
        reach = self.most * max(map(abs, q_whole), default=0) * max(1, len(q_whole))
        if reach < 1 << 53:
            return (self.x[part] @ q).astype(np.int64)
        if reach < 1 << 63:
            return self.whole[part] @ np.array(q_whole, np.int64)
        exact = [sum(a * b for a, b in zip(row, q_whole, strict=True)) for row in self.whole[part].tolist()]
        return np.array([max(-LONG - 1, min(LONG, s)) for s in exact], np.int64)

    def search(self, q_ids: np.ndarray, q_whole: np.ndarray, k: int, step: int = 64):
        """(query number, ids, scores, candidates evaluated) of each query's best ``k``."""
        for at in range(0, len(q_ids), step):
            q = q_whole[at : at + step].astype(np.float64)
            for i, bound in enumerate(self.bounds(q)):
                bound[self.ids == q_ids[at + i]] = -np.inf
                whole = q_whole[at + i].tolist()
                yield at + i, *self._best(bound, q[i], whole, k)

    def _best(self, bound: np.ndarray, q: np.ndarray, whole: list[int], k: int) -> tuple[np.ndarray, np.ndarray, int]:
        ids, scores, seen, step = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, max(64, 4 * k)
        left = np.flatnonzero(bound > -np.inf)
        while len(left):
            if len(left) > step:  # the highest bounds first
                left = left[np.argpartition(-bound[left], step - 1)]
            part, left = left[:step], left[step:]
            seen += len(part)
            i, s = np.concatenate([ids, self.ids[part]]), np.concatenate([scores, self.scores(part, q, whole)])
            keep = np.lexsort((i, ~s))[:k]  # ~s falls as s rises, and fits
            ids, scores = i[keep], s[keep]
            if len(scores) >= k:
                left = left[bound[left] >= scores[-1]]
        return ids, scores, seen


def _found(vectors: DataFrame, queries: DataFrame, k: int, block: int | None, query_block: int) -> DataFrame:
    """(query_id, query_hash, cb, vec_id, score, evaluated, candidates): the best of each block for each query."""
    # of equal rows no more than k can be among the best, so they are never one large group
    vectors = durable(vectors.groupBy("vec_id", "v").agg(F.least(F.count(F.lit(1)), F.lit(k)).cast("int").alias("times")))
    queries = queries.distinct()
    pivots = choose_pivots(vectors)
    n, wide = vectors.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    nq = queries.count()
    rows = max(64, min(BLOCK_ROWS, BLOCK_BYTES // (8 * max(1, wide))))
    block, query_block = block or rows, min(query_block, rows)
    least = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions", "8"))
    blocks, query_blocks = max(1, -(-n // block), min(least, -(-n // 1024))), max(1, -(-nq // query_block))
    spread = lambda col, m: F.pmod(F.xxhash64(col, "v"), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    vectors = vectors.withColumn("vec_id", F.explode(F.array_repeat("vec_id", F.col("times"))))
    cand = vectors.select(F.size("v").alias("dim"), spread("vec_id", blocks).alias("cb"), every(query_blocks).alias("qb"), "vec_id", "v")
    ask = queries.select(F.size("v").alias("dim"), every(blocks).alias("cb"), spread("vec_id", query_blocks).alias("qb"), "vec_id", "v")
    names = ["query_id", "query_hash", "cb", "vec_id", "score", "evaluated", "candidates"]

    def pair(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(c):
            dim = len(c.v.iloc[0])
            matrix = lambda v: np.stack(v.to_numpy()).astype(np.int64).reshape(len(v), dim)
            table_, asked = PivotTable(c.vec_id.to_numpy(), matrix(c.v), pivots.get(dim, np.zeros((0, dim)))), matrix(q.v)
            for i, ids, scores, seen in table_.search(q.vec_id.to_numpy(), asked, k):
                out.append(pd.DataFrame({"query_id": q.vec_id.iloc[i], "query_hash": hash(tuple(asked[i].tolist())), "cb": c.cb.iloc[0], "vec_id": ids, "score": scores, "evaluated": seen, "candidates": len(c)}))
        return pd.concat(out)[names] if out else pd.DataFrame({x: pd.Series(dtype="int64") for x in names})

    key = ["dim", "cb", "qb"]
    return ask.groupBy(*key).cogroup(cand.groupBy(*key)).applyInPandas(pair, ", ".join(f"{x} long" for x in names))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int | None = None, query_block: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` best of ``vectors`` for each row of ``queries``; both (vec_id, v)."""
    found = _found(vectors, queries, k, block, query_block)
    rank = F.row_number().over(Window.partitionBy("query_id", "query_hash").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def evaluations(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int | None = None, query_block: int = 4096) -> DataFrame:
    """(query_id, evaluated, candidates): how many scores the search computes for each query, and how many there are."""
    found = _found(vectors, queries, k, block, query_block)
    per = found.groupBy("query_id", "query_hash", "cb").agg(F.max("evaluated").alias("evaluated"), F.max("candidates").alias("candidates"))
    return per.groupBy("query_id", "query_hash").agg(F.sum("evaluated").alias("evaluated"), F.sum("candidates").alias("candidates")).drop("query_hash")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = integer_vectors(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.filter("vec_id % 50 = 0"))


QUERIES = {"op1_topk": op1_topk}
ORACLE = {
    "op1_topk": """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) v FROM embeddings
               WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id query_id, q.v, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::bigint score
          FROM (SELECT DISTINCT * FROM v WHERE vec_id % 50 = 0) q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
    SELECT query_id, rank::int AS rank, vec_id, score FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id, v ORDER BY score DESC, vec_id) rank FROM s) WHERE rank <= 5"""
}
