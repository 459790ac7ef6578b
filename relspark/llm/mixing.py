r"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame functions only.

A document's size is its number of words ``[^\x20\x09-\x0D]+``.  Sources, by code point with null last, weigh 5, 2, 1,
repeating; together they get ``total`` times all words, none more than ``most`` times its own; the excess is dealt anew
by weight until none is above.  Each document of a source then has target / source size copies: a whole part and a
probability.  Probabilities are rounded in pairs: words move from one document to the other, by a fair draw that keeps
each one's expected copies, until one of the two is whole.  The words of a source are kept exactly by each transfer.  Blocks of about 128 documents
are reduced first, then blocks of their leftovers, and so on; the one leftover of a source is drawn by its probability.
So every document's copies are right on average, and a source misses its target by less than one document.

Draws are hashes of the pair, so reruns agree.  Rows with equal doc_id, source and size are one unit: their copies add up
to a whole part and one probability, and are dealt out evenly, the first ones taking what is over.  A null text
has size 0; documents of size 0 take nothing.  An empty table gives no rows.  Other columns are not read by ``mix`` and
are kept by ``mixed_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._common import durable, small, table

BLOCK = 128
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=(5.0, 2.0, 1.0), total: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, n, target) of each source: one row a source, so the windows below hold few rows."""
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    every = W.partitionBy(F.lit(0))
    rank = F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")))
    s = s.withColumns({"cap": F.lit(most) * F.col("source_size"), "all_words": F.lit(total) * F.sum("source_size").over(every)})
    by = every.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(by.rowsBetween(0, W.unboundedFollowing))
    s = s.withColumn("level", (F.col("all_words") - before) / left)
    # the level rises while sources are capped and falls after the last of them
    s = s.withColumn("target", F.least("cap", F.col("weight") * F.max("level").over(every)))
    return s.select("source", "source_size", "n", "target")


#: One step: ``a.cur`` and ``u`` are (id, s, p): a document, its words and its probability.
_STEP = """
(a, u) -> CASE WHEN a.cur IS NULL THEN named_struct('cur', u, 'out', a.out) ELSE
 transform(array(named_struct(
   'up', least(a.cur.s * (1 - a.cur.p), u.s * u.p), 'down', least(a.cur.s * a.cur.p, u.s * (1 - u.p)),
   'draw', pmod(xxhash64(a.cur.id, u.id, {seed}), 1048576) / 1048576D)), d ->
 CASE WHEN d.draw * (d.up + d.down) < d.down THEN
   CASE WHEN a.cur.s * (1 - a.cur.p) <= u.s * u.p
     THEN named_struct('cur', named_struct('id', u.id, 's', u.s, 'p', greatest(0D, u.p - d.up / u.s)), 'out', concat(a.out, array(named_struct('id', a.cur.id, 'bit', 1L))))
     ELSE named_struct('cur', named_struct('id', a.cur.id, 's', a.cur.s, 'p', least(1D, a.cur.p + d.up / a.cur.s)), 'out', concat(a.out, array(named_struct('id', u.id, 'bit', 0L)))) END
 ELSE
   CASE WHEN a.cur.s * a.cur.p <= u.s * (1 - u.p)
     THEN named_struct('cur', named_struct('id', u.id, 's', u.s, 'p', least(1D, u.p + d.down / u.s)), 'out', concat(a.out, array(named_struct('id', a.cur.id, 'bit', 0L))))
     ELSE named_struct('cur', named_struct('id', a.cur.id, 's', a.cur.s, 'p', greatest(0D, a.cur.p - d.down / a.cur.s)), 'out', concat(a.out, array(named_struct('id', u.id, 'bit', 1L)))) END
 END)[0] END"""
_UNIT = "struct<id:struct<doc_id:bigint,source:string,size:bigint,m:bigint,base:bigint>,s:double,p:double>"
_OUT = "array<struct<id:struct<doc_id:bigint,source:string,size:bigint,m:bigint,base:bigint>,bit:bigint>>"


def _reduce(units: DataFrame, seed: int) -> DataFrame:
    """(src, block, cur, out) from (src, block, unit); larger documents come first, so that the leftover tends to be small."""
    lists = units.groupBy("src", "block").agg(F.collect_list(F.struct((-F.col("unit.s")).alias("k"), F.xxhash64("unit.id").alias("h"), "unit")).alias("l"))
    folded = F.expr(
        f"aggregate(transform(array_sort(l), x -> x.unit), cast(named_struct('cur', null, 'out', array()) as struct<cur:{_UNIT},out:{_OUT}>), {_STEP.format(seed=f'{seed}L')})"
    )
    return lists.select("src", "block", folded.alias("f")).select("src", "block", "f.cur", "f.out")


def _draw(*parts) -> Column:
    """A number from 0 up to 1."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 20)) / F.lit(float(1 << 20))


def decide(sizes: DataFrame, seed: int = 7, **kinds) -> tuple[DataFrame, DataFrame]:
    """((doc_id, source, size, m, copies), sources) from (doc_id, source, size); m rows are equal and have all copies together."""
    sources = durable(targets(sizes, **kinds))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK)).cast("long")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    per = sources.select(F.col("source").alias("src"), blocks.alias("blocks"), rate.alias("rate"))
    units = sizes.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("m"))
    units = units.join(small(per), F.col("source").eqNullSafe(F.col("src")))
    whole = F.floor(F.col("rate") * F.col("m") + 1e-9)
    units = units.withColumns({"base": whole, "p": F.greatest(F.lit(0.0), F.col("rate") * F.col("m") - whole)})
    taking = (F.col("size") > 0) & (F.col("p") > 1e-12)
    key = F.struct("doc_id", "source", "size", "m", "base")
    done = [units.filter(~taking).select(key.alias("id"), F.lit(0).cast("long").alias("bit"))]
    level = units.filter(taking).select("src", F.pmod(F.xxhash64("doc_id", "size"), F.col("blocks")).alias("block"), F.struct(key.alias("id"), F.col("size").cast("double").alias("s"), "p").alias("unit"))
    most = per.agg(F.coalesce(F.max("blocks"), F.lit(1))).first()[0]
    while True:
        level = durable(_reduce(level, seed))
        done.append(level.select(F.explode("out").alias("x")).select("x.id", "x.bit"))
        if most <= 1:
            break
        most = -(-most // BLOCK)
        level = level.select("src", F.floor(F.col("block") / BLOCK).alias("block"), F.col("cur").alias("unit"))
    done.append(level.select("cur.id", (_draw("cur.id", F.lit(seed)) < F.col("cur.p")).cast("long").alias("bit")))
    out = done[0]
    for x in done[1:]:
        out = out.union(x)
    return out.select("id.doc_id", "id.source", "id.size", "id.m", (F.col("id.base") + F.col("bit")).alias("copies")), sources


def _sizes(docs: DataFrame) -> DataFrame:
    return durable(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size")))


def mix(docs: DataFrame, **kinds) -> DataFrame:
    """A row for each document: (doc_id, size, source_size, target, taken)."""
    decided, sources = decide(_sizes(docs), **kinds)
    out = decided.join(small(sources.select(F.col("source").alias("src"), "source_size", "target")), F.col("source").eqNullSafe(F.col("src")))
    out = out.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))))
    own = F.floor(F.col("copies") / F.col("m")) + (F.col("row") <= F.col("copies") % F.col("m")).cast("long")
    return out.select("doc_id", "size", "source_size", "target", (own * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, **kinds) -> DataFrame:
    """``docs`` with each row as often as the mix takes it; documents without words stay once."""
    sizes = _sizes(docs)
    decided = durable(decide(sizes, **kinds)[0])
    took = decided.filter("size > 0 and copies <> m").select(F.col("doc_id").alias("__d"), F.xxhash64("source").alias("__s"), F.col("size").alias("__n"), F.col("copies").alias("__c"), F.col("m").alias("__m"))
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("__d")) & (F.xxhash64(docs["source"].cast("string")) == F.col("__s")) & (n_words(docs["text"]) == F.col("__n"))
    names = [F.col(f"`{c}`") for c in docs.columns]
    times = lambda rows, c: rows.withColumn("__t", c).filter("__t > 0").withColumn("__r", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__t")))).select(*names)
    if decided.filter("m > 1").isEmpty():
        return times(docs.join(small(took), same, "left"), F.coalesce("__c", F.lit(1).cast("long")))
    rows = docs.join(small(took), same, "left")
    # rows that stand for one unit: equal rows count once, and a unit's different rows take their turns by text
    unit = W.partitionBy("__d", "__s", "__n")
    kinds_ = rows.filter("__m > 1").groupBy(*docs.columns, "__d", "__s", "__n", "__c", "__m").agg(F.count(F.lit(1)).alias("__k"))
    before = F.sum("__k").over(unit.orderBy(F.xxhash64(*names)).rowsBetween(W.unboundedPreceding, -1))
    over = F.greatest(F.lit(0).cast("long"), F.least(F.col("__k"), F.col("__c") % F.col("__m") - F.coalesce(before, F.lit(0))))
    shared = times(kinds_.withColumn("__o", over), F.col("__k") * F.floor(F.col("__c") / F.col("__m")) + F.col("__o"))
    return times(rows.filter("coalesce(__m, 1) = 1"), F.coalesce("__c", F.lit(1).cast("long"))).unionAll(shared)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


QUERIES = {"op4_mixing": op4_mixing}
ORACLE: dict[str, str] = {}
