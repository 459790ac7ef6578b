"""Equi-joins whose keys repeat on both sides: what they give grows with the product of a key's rows, not with the input.

Spark deals out a join's work by the bytes it reads, so a small table can put all pairs into one task.  Here a key with many
pairs is cut into cells of about CELL by CELL rows, each row goes to all cells of its row or column, and the cells are dealt
over the cluster.  Every pair is in exactly one cell.  Row counts of keys decide what is cut, as part of the lazy plan;
what is copied is about 2 / CELL of the pairs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column as Col
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of each side in a cell, and rows of a right side that a join may hold for one key.
CELL, HELD = 2048, 1 << 16


def _all(conditions) -> Col:
    return reduce(lambda a, b: a & b, conditions)


def _counted(df: DataFrame, keys: list[Col], name: str) -> DataFrame:
    return df.groupBy(*(k.alias(f"{name}{i}") for i, k in enumerate(keys))).agg(F.count(F.lit(1)).alias(name))


def _dealt(df: DataFrame, cut: DataFrame, keys: list[Col], row: list[Col], own: str, other: str, mine: str, theirs: str) -> DataFrame:
    """``df`` with a chunk of its own in ``mine``, once for each of the other side's chunks in ``theirs``."""
    df = df.join(F.broadcast(cut), _all(k == F.col(f"__l{i}") for i, k in enumerate(keys)), "left")
    chunk = F.pmod(F.xxhash64(*row), F.coalesce(own, F.lit(1))).cast("int").alias(mine)
    return df.select("*", chunk, F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1)).alias(theirs))


def _alike(left: DataFrame, right: DataFrame, ls: list[Col], rs: list[Col]) -> tuple[list[Col], list[Col]]:
    """The keys in the types that a join compares them in; else it would shuffle anew, by bytes."""
    a, b = left.select(*(k.alias(f"k{i}") for i, k in enumerate(ls))), right.select(*(k.alias(f"k{i}") for i, k in enumerate(rs)))
    kinds = zip(a.schema.fields, b.schema.fields, a.union(b).schema.fields, strict=True)
    cast = [(x.dataType != y.dataType, z.dataType) for x, y, z in kinds]
    return [k.cast(t) if c else k for k, (c, t) in zip(ls, cast, strict=True)], [k.cast(t) if c else k for k, (c, t) in zip(rs, cast, strict=True)]


def spread_join(left: DataFrame, right: DataFrame, keys: list[tuple[Col, Col]], condition: Col, how: str, rows: tuple[list[Col], list[Col]]) -> DataFrame:
    """``left.join(right, condition, how)`` (inner or left), where ``condition`` holds only if all ``keys`` are equal; a left join has no other condition.

    ``rows`` are the columns of each side that tell its rows apart; equal ones stay together.
    """
    spark, ls, rs = left.sparkSession, [a for a, _ in keys], [b for _, b in keys]
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    both = _counted(left, ls, "__l").join(_counted(right, rs, "__r"), _all(F.col(f"__l{i}") == F.col(f"__r{i}") for i in range(len(keys))))
    much = (F.col("__l").cast("double") * F.col("__r") > CELL * CELL) | (F.col("__r") > HELD)
    chunks = [F.ceil(F.col(c) / CELL).cast("int").alias(f"{c}_chunks") for c in ("__l", "__r")]
    names = [f"__l{i}" for i in range(len(keys))]
    cut = both.filter(much).select(*names, *chunks)
    one = _dealt(left, cut, ls, rows[0], "__l_chunks", "__r_chunks", "__row", "__column").withColumn("__cut", F.col("__l_chunks").isNotNull()).drop(*names, "__l_chunks", "__r_chunks")
    two = _dealt(right, cut, rs, rows[1], "__r_chunks", "__l_chunks", "__at_column", "__at_row").drop(*names, "__l_chunks", "__r_chunks")
    ls, rs = _alike(left, right, ls, rs)
    one, two = one.repartition(n, *ls, "__row", "__column"), two.repartition(n, *rs, "__at_row", "__at_column")
    out = one.join(two.hint("merge"), condition & (F.col("__row") == F.col("__at_row")) & (F.col("__column") == F.col("__at_column")), how)
    if how == "left":  # a row of a cut key has matches; where it is alone, a chunk is empty
        out = out.filter(~F.col("__cut") | F.col("__at_column").isNotNull())
    return out.drop("__row", "__column", "__cut", "__at_row", "__at_column")
