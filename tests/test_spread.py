"""Joins whose keys repeat on both sides: every pair once, dealt over the cluster."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from relspark import Type, create, op
from relspark.plans import spread
from relspark.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture
def cells(monkeypatch):
    """Cells so small that the keys of small tables are cut."""
    monkeypatch.setattr(spread, "CELL", 4)
    monkeypatch.setattr(spread, "HELD", 32)


def largest_share(df):
    n = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    return max(n) / sum(n)


def same_as_sql(spark, name, sf=SF):
    c = duckdb.connect()
    for t in ("nation", "customer", "supplier", "orders"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = QUERIES[name](spark, sf)
    got, want = df.toPandas(), c.execute(ORACLE[name]).fetchdf()[df.columns]
    assert len(want) > 0
    return Counter(got.itertuples(index=False, name=None)) == Counter(want.itertuples(index=False, name=None))


def test_inner_then_left_is_dealt_out(spark, cells):
    assert same_as_sql(spark, "join_inner_then_left")
    assert largest_share(QUERIES["join_inner_then_left"](spark, SF)) < 0.25


@pytest.mark.parametrize("name", ["join_residual", "join_residual_nulls", "join_self"])
def test_joins_by_where_are_dealt_out(spark, cells, name):
    assert same_as_sql(spark, name)
    if name != "join_self":  # 60 rows are too few to tell
        assert largest_share(QUERIES[name](spark, SF)) < 0.25


def test_cells_of_full_size(spark):
    """18 million of the 36 million pairs of one key, cut as in use: each once, and no task has most of them."""
    b, n = create("full"), 6000
    for t in ("one", "two"):
        b.create_table(t).add_column("id", Type.INTEGER).add_column("k", Type.INTEGER).add_column("v", Type.INTEGER).add_primary_key(["id"])
    db = b.connect(spark)
    for t, shift in (("one", 0), ("two", 1)):
        db.attach(t, spark.range(0, n, 1, 1).select("id", (F.col("id") % 1).alias("k"), (F.col("id") + shift).alias("v")), F.col("id"))
    one, two = db.table("one"), db.table("two")
    df = db.select(one.id.as_("a"), two.id.as_("b")).from_(one, two).where(op.and_(one.k.eq(two.k), one.v.lt(two.v))).exec_df()
    got = df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b")).collect()
    # pairs with a <= b: a meets n - a, b meets b + 1
    assert [sum(r[c] for r in got) for c in "nab"] == [n * (n + 1) // 2, sum(a * (n - a) for a in range(n)), sum(b * (b + 1) for b in range(n))]
    assert max(r["n"] for r in got) < 0.6 * n * (n + 1) / 2


def pairs(spark, left, right, kinds=("long", "long"), how="left", keyed=False):
    """(left id, right id) of rows with equal ``k``, as the engine and as plain Python give them."""
    b = create("pairs")
    for n in ("one", "two"):
        t = b.create_table(n).add_column("id", Type.INTEGER).add_column("k", Type.INTEGER).add_nullable(["k"])
        if keyed:
            t.add_primary_key(["id"])
    db = b.connect(spark)
    for n, rows, kind in (("one", left, kinds[0]), ("two", right, kinds[1])):
        df = spark.createDataFrame(rows, f"id long, k {kind}")
        db.attach(n, df, F.col("id") if keyed else None)
    one, two = db.table("one"), db.table("two")
    q = db.select(one.id.as_("a"), two.id.as_("b")).from_(one)
    q = q.left_outer_join(two, one.k.eq(two.k)) if how == "left" else q.inner_join(two, one.k.eq(two.k))
    want = [(a, b) for a, k in left for b, j in right if k is not None and k == j]
    if how == "left":
        held = {j for _, j in right if j is not None}
        want += [(a, None) for a, k in left if k not in held]
    return Counter((r["a"], r["b"]) for r in q.exec_df().collect()), Counter(want), q.exec_df()


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("keyed", [True, False])
def test_cut_keys_nulls_and_unmatched(spark, cells, how, keyed):
    left = [(i, [None, 1, 2, 3, 1, 1][i % 6]) for i in range(120)]
    right = [(i, [None, 1, 1, 2, 5][i % 5]) for i in range(100)]
    got, want, _ = pairs(spark, left, right, how=how, keyed=keyed)
    assert got == want


@pytest.mark.parametrize("how", ["left", "inner"])
def test_copies_and_empty_sides(spark, cells, how):
    """Without a row id copies share a chunk, so that others are empty."""
    same = [(7, 1)] * 30
    for left, right in ((same, same), (same, [(1, 1), (2, 2)]), (same, []), ([], same), ([(1, 1)], same * 2)):
        got, want, _ = pairs(spark, left, right, how=how)
        assert got == want


def test_keys_of_two_types(spark, cells):
    left, right = [(i, i % 2) for i in range(60)], [(i, i % 3) for i in range(60)]
    got, want, df = pairs(spark, left, right, ("int", "long"), keyed=True)
    assert got == want and largest_share(df) < 0.25


def test_unique_keys_are_left_to_the_optimizer(spark):
    for name in ("join_left", "join_multi3", "join_left_then_inner", "segment_totals"):
        assert "__row" not in QUERIES[name](spark, SF)._jdf.queryExecution().toString()


def test_three_tables_and_residuals(spark, cells):
    b = create("three")
    for n in "xyz":
        b.create_table(n).add_column("id", Type.INTEGER).add_column("k", Type.INTEGER).add_column("v", Type.INTEGER).add_primary_key(["id"])
    db = b.connect(spark)
    rows = {n: [(i, i % m, i * 7 % 11) for i in range(20)] for n, m in (("x", 2), ("y", 3), ("z", 2))}
    for n, r in rows.items():
        db.attach(n, spark.createDataFrame(r, "id long, k long, v long"), F.col("id"))
    x, y, z = (db.table(n) for n in "xyz")
    q = db.select(x.id.as_("x"), y.id.as_("y"), z.id.as_("z")).from_(x, y, z).where(op.and_(x.k.eq(y.k), op.and_(z.k.eq(x.k), y.v.lt(z.v)), x.v.gt(3)))
    want = [(a, b, c) for a, k, v in rows["x"] for b, m, w in rows["y"] for c, j, u in rows["z"] if k == m and j == k and w < u and v > 3]
    assert Counter(tuple(r) for r in q.exec_df().collect()) == Counter(want) and want
