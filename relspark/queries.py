"""One query for each feature of the engine, over the benchmark tables, with the SQL that checks it."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .database import Database
from .errors import EngineError
from .functions import bind, fn, op
from .operators.constraints import null_rows, orphans, repeated_keys
from .schema import ForeignKey, create
from .streaming.observe import result_diff
from .types import ConstraintAction, ConstraintTiming, Order, Type

TABLES = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "lineitem": None, "events": "event_id"}
#: Where a query needs nulls, which the tables lack.
NULLED = {"orders": ("o_orderpriority", "3-MEDIUM"), "part": ("p_size", 7), "customer": ("c_nationkey", 3)}


def database(spark: SparkSession, sf_dir: str, *names: str, nulls: bool = False) -> Database:
    b = create("shop")
    frames = {}
    for n in names:
        df = spark.read.parquet(f"{sf_dir}/{n}.parquet")
        if nulls and n in NULLED:
            c, v = NULLED[n]
            df = df.withColumn(c, F.when(F.col(c) != v, F.col(c)))
        frames[n] = df
        key = TABLES[n]
        b.table_from(n, df, [key] if key else [], "*")
    db = b.connect(spark)
    for n, df in frames.items():
        db.attach(n, df, F.col(TABLES[n]).cast("long") if TABLES[n] else F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    return db


QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None, *names: str, nulls: bool = False):
    """Registers f(db, tables...) under its name."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            db = database(spark, sf_dir, *names, nulls=nulls)
            out = f(db, *(db.table(n) for n in names))
            return out if isinstance(out, DataFrame) else out.exec_df()

        run.__name__, run.build = f.__name__, f
        QUERIES[f.__name__] = run
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


N_ORDERS = "(SELECT * REPLACE (NULLIF(o_orderpriority, '3-MEDIUM') AS o_orderpriority) FROM orders) orders"
N_PART = "(SELECT * REPLACE (NULLIF(p_size, 7) AS p_size) FROM part) part"
N_CUSTOMER = "(SELECT * REPLACE (NULLIF(c_nationkey, 3) AS c_nationkey) FROM customer) customer"
D = dt.datetime


# --- projection


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation", "nation")
def scan_all(db, n):
    return db.select().from_(n)


@query("SELECT n_name, n_regionkey FROM nation", "nation")
def project_cols(db, n):
    return db.select(n.n_name, n.n_regionkey).from_(n)


@query("SELECT n_name AS name, n_regionkey AS region FROM nation", "nation")
def project_alias(db, n):
    return db.select(n.n_name.as_("name"), n.n_regionkey.as_("region")).from_(n)


# --- predicates

for _name, _sql in (("eq", "="), ("neq", "<>"), ("lt", "<"), ("lte", "<="), ("gt", ">"), ("gte", ">=")):

    def _pred(db, t, _m=_name):
        return db.select(t.l_orderkey, t.l_linenumber, t.l_quantity).from_(t).where(getattr(t.l_quantity, _m)(25.0))

    _pred.__name__ = f"pred_{_name}"
    query(f"SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity {_sql} 25", "lineitem")(_pred)


@query("SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem WHERE l_shipdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1995-12-31'", "lineitem")
def pred_between(db, t):
    return db.select(t.l_orderkey, t.l_linenumber, t.l_shipdate).from_(t).where(t.l_shipdate.between(D(1995, 1, 1), D(1995, 12, 31)))


@query("SELECT p_partkey, p_brand FROM part WHERE p_brand IN ('Brand#1', 'Brand#12', 'Brand#23')", "part")
def pred_in(db, t):
    return db.select(t.p_partkey, t.p_brand).from_(t).where(t.p_brand.in_(["Brand#1", "Brand#12", "Brand#23"]))


@query("SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '^(red|hot) .*(ring|bolt)$')", "part")
def pred_match(db, t):
    return db.select(t.p_partkey, t.p_name).from_(t).where(t.p_name.match("^(red|hot) .*(ring|bolt)$"))


@query("SELECT p_partkey, p_type FROM part WHERE regexp_matches(p_type, '(?i)^[a-m]')", "part")
def pred_match_flags(db, t):
    return db.select(t.p_partkey, t.p_type).from_(t).where(t.p_type.match(re.compile("^[a-m]", re.I)))


@query(f"SELECT o_orderkey FROM {N_ORDERS} WHERE o_orderpriority IS NULL", "orders", nulls=True)
def pred_isnull(db, t):
    return db.select(t.o_orderkey).from_(t).where(t.o_orderpriority.is_null())


@query(f"SELECT o_orderkey, o_orderpriority FROM {N_ORDERS} WHERE o_orderpriority IS NOT NULL", "orders", nulls=True)
def pred_isnotnull(db, t):
    return db.select(t.o_orderkey, t.o_orderpriority).from_(t).where(t.o_orderpriority.is_not_null())


@query(f"SELECT o_orderkey, o_orderpriority FROM {N_ORDERS} WHERE o_orderpriority IS DISTINCT FROM '1-URGENT'", "orders", nulls=True)
def pred_neq_null_rows(db, t):
    return db.select(t.o_orderkey, t.o_orderpriority).from_(t).where(t.o_orderpriority.neq("1-URGENT"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity < 10 AND l_discount >= 0.05 AND l_returnflag = 'R'", "lineitem")
def pred_and(db, t):
    return db.select(t.l_orderkey, t.l_linenumber).from_(t).where(op.and_(t.l_quantity.lt(10.0), t.l_discount.gte(0.05), t.l_returnflag.eq("R")))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity < 3 OR l_tax > 0.07 OR l_linestatus = 'F'", "lineitem")
def pred_or(db, t):
    return db.select(t.l_orderkey, t.l_linenumber).from_(t).where(op.or_(t.l_quantity.lt(3.0), t.l_tax.gt(0.07), t.l_linestatus.eq("F")))


@query(f"SELECT p_partkey, p_size FROM {N_PART} WHERE NOT coalesce(p_size > 20, false)", "part", nulls=True)
def pred_not_cmp(db, t):
    return db.select(t.p_partkey, t.p_size).from_(t).where(op.not_(t.p_size.gt(20)))


@query(f"SELECT p_partkey, p_size FROM {N_PART} WHERE p_size IS NOT NULL AND p_size NOT IN (1, 2, 3, 4, 5)", "part", nulls=True)
def pred_not_in_null(db, t):
    return db.select(t.p_partkey, t.p_size).from_(t).where(op.not_(t.p_size.in_([1, 2, 3, 4, 5])))


@query(f"SELECT p_partkey FROM {N_PART} WHERE NOT coalesce(p_size > 20, false) OR NOT coalesce(p_retailprice < 1200, false)", "part", nulls=True)
def pred_not_and(db, t):
    return db.select(t.p_partkey).from_(t).where(op.not_(op.and_(t.p_size.gt(20), t.p_retailprice.lt(1200.0))))


@query(f"SELECT p_partkey FROM {N_PART} WHERE NOT coalesce(p_size BETWEEN 10 AND 30, false) AND p_retailprice IS DISTINCT FROM 1000", "part", nulls=True)
def pred_not_or(db, t):
    return db.select(t.p_partkey).from_(t).where(op.not_(op.or_(t.p_size.between(10, 30), t.p_retailprice.eq(1000.0))))


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate = TIMESTAMP '1996-01-02'", "orders")
def pred_date_eq(db, t):
    return db.select(t.o_orderkey, t.o_orderdate).from_(t).where(t.o_orderdate.eq(D(1996, 1, 2)))


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1996-04-01'", "orders")
def pred_date_range(db, t):
    return db.select(t.o_orderkey, t.o_orderdate).from_(t).where(op.and_(t.o_orderdate.gte(D(1996, 1, 1)), t.o_orderdate.lt(D(1996, 4, 1))))


# --- parameters


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 50000 AND 100000", "orders")
def bind_between(db, t):
    return db.select(t.o_orderkey, t.o_totalprice).from_(t).where(t.o_totalprice.between(bind(0), bind(1))).bind([50000.0, 100000.0])


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P')", "orders")
def bind_in(db, t):
    return db.select(t.o_orderkey).from_(t).where(t.o_orderstatus.in_([bind(1), bind(0)])).bind(["P", "F"])


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 30", "orders")
def bind_limit_skip(db, t):
    return db.select(t.o_orderkey).from_(t).order_by(t.o_orderkey).limit(bind(0)).skip(bind(1)).bind([20, 30])


# --- joins


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey", "nation", "region")
def join_inner(db, n, r):
    return db.select(n.n_name, r.r_name).from_(n).inner_join(r, n.n_regionkey.eq(r.r_regionkey))


@query("SELECT o_orderkey, c_name FROM orders, customer WHERE o_custkey = c_custkey AND o_totalprice > 250000", "orders", "customer")
def join_implicit(db, o, c):
    return db.select(o.o_orderkey, c.c_name).from_(o, c).where(op.and_(o.o_custkey.eq(c.c_custkey), o.o_totalprice.gt(250000.0)))


@query("SELECT a.n_name AS left_name, b.n_name AS right_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_name < 'NATION_2'", "nation")
def join_self(db, n):
    a, b = n.as_("a"), n.as_("b")
    return db.select(a.n_name.as_("left_name"), b.n_name.as_("right_name")).from_(a).inner_join(b, a.n_regionkey.eq(b.n_regionkey)).where(a.n_name.lt("NATION_2"))


@query("SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey", "customer", "nation", "region")
def join_multi3(db, c, n, r):
    return db.select(c.c_custkey, n.n_name, r.r_name).from_(c).inner_join(n, c.c_nationkey.eq(n.n_nationkey)).inner_join(r, n.n_regionkey.eq(r.r_regionkey))


@query("SELECT n_name, r_name FROM nation CROSS JOIN region", "nation", "region")
def join_cross(db, n, r):
    return db.select(n.n_name, r.r_name).from_(n, r)


@query("SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey AND c_acctbal < s_acctbal", "customer", "supplier")
def join_residual(db, c, s):
    return db.select(c.c_custkey, s.s_suppkey).from_(c, s).where(op.and_(c.c_nationkey.eq(s.s_nationkey), c.c_acctbal.lt(s.s_acctbal)))


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey", "customer", "orders")
def join_left(db, c, o):
    return db.select(c.c_custkey, o.o_orderkey).from_(c).left_outer_join(o, c.c_custkey.eq(o.o_custkey))


@query("SELECT c.c_custkey FROM customer c LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 300000) o ON c.c_custkey = o.o_custkey WHERE o.o_orderkey IS NULL", "customer", "orders")
def join_left_where_null(db, c, o):
    few = db.select().from_(o).where(op.and_(o.o_orderstatus.eq("P"), o.o_totalprice.gt(300000.0))).exec_df()
    db.attach("orders", few)
    return db.select(c.c_custkey).from_(c).left_outer_join(o, c.c_custkey.eq(o.o_custkey)).where(o.o_orderkey.is_null())


@query("SELECT c_custkey, o_orderkey, n_name FROM customer LEFT JOIN orders ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey", "customer", "orders", "nation")
def join_left_then_inner(db, c, o, n):
    return db.select(c.c_custkey, o.o_orderkey, n.n_name).from_(c).left_outer_join(o, c.c_custkey.eq(o.o_custkey)).inner_join(n, c.c_nationkey.eq(n.n_nationkey))


@query("SELECT n_name, s_suppkey, c_custkey FROM nation JOIN supplier ON n_nationkey = s_nationkey LEFT JOIN customer ON n_nationkey = c_nationkey", "nation", "supplier", "customer")
def join_inner_then_left(db, n, s, c):
    return db.select(n.n_name, s.s_suppkey, c.c_custkey).from_(n).inner_join(s, n.n_nationkey.eq(s.s_nationkey)).left_outer_join(c, n.n_nationkey.eq(c.c_nationkey))


@query("SELECT s_suppkey, c_custkey FROM supplier LEFT JOIN customer ON c_custkey = s_suppkey", "supplier", "customer")
def join_left_reversed(db, s, c):
    return db.select(s.s_suppkey, c.c_custkey).from_(s).left_outer_join(c, c.c_custkey.eq(s.s_suppkey))


@query(f"SELECT c_custkey, n_name FROM {N_CUSTOMER} LEFT JOIN nation ON c_nationkey = n_nationkey", "customer", "nation", nulls=True)
def join_left_null_keys(db, c, n):
    return db.select(c.c_custkey, n.n_name).from_(c).left_outer_join(n, c.c_nationkey.eq(n.n_nationkey))


@query("SELECT s_suppkey, r_regionkey FROM supplier JOIN region ON s_nationkey < r_regionkey", "supplier", "region")
def join_theta_lt(db, s, r):
    return db.select(s.s_suppkey, r.r_regionkey).from_(s).inner_join(r, s.s_nationkey.lt(r.r_regionkey))


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey <> r_regionkey", "nation", "region")
def join_theta_neq(db, n, r):
    return db.select(n.n_name, r.r_name).from_(n).inner_join(r, n.n_regionkey.neq(r.r_regionkey))


@query("SELECT s_suppkey, r_regionkey FROM supplier LEFT JOIN region ON s_nationkey < r_regionkey", "supplier", "region")
def join_left_theta(db, s, r):
    return db.select(s.s_suppkey, r.r_regionkey).from_(s).left_outer_join(r, s.s_nationkey.lt(r.r_regionkey))


@query("SELECT to_json({'n_name': n_name, 'n_nationkey': n_nationkey})::varchar AS nation, to_json({'r_name': r_name})::varchar AS region FROM nation JOIN region ON n_regionkey = r_regionkey", "nation", "region")
def join_nested_structs(db, n, r):
    df = db.select(n.n_name, n.n_nationkey, r.r_name).from_(n).inner_join(r, n.n_regionkey.eq(r.r_regionkey)).exec_df(nested=True)
    return df.select(*(F.to_json(c).alias(c) for c in df.columns))  # one struct for each table, as text


@query(f"WITH o AS (SELECT * FROM {N_ORDERS}) SELECT a.o_orderkey AS one, b.o_orderkey AS other FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND a.o_orderpriority = b.o_orderpriority AND a.o_orderkey < b.o_orderkey", "orders", nulls=True)
def join_residual_nulls(db, o):
    """A second predicate between joined tables: null matches nothing."""
    a, b = o.as_("a"), o.as_("b")
    return db.select(a.o_orderkey.as_("one"), b.o_orderkey.as_("other")).from_(a, b).where(op.and_(a.o_custkey.eq(b.o_custkey), a.o_orderpriority.eq(b.o_orderpriority), a.o_orderkey.lt(b.o_orderkey)))


# --- aggregates


@query("SELECT count(*) AS n FROM lineitem", "lineitem")
def agg_count_star(db, t):
    return db.select(fn.count().as_("n")).from_(t)


@query(f"SELECT count(o_orderpriority) AS n, count(*) AS total FROM {N_ORDERS}", "orders", nulls=True)
def agg_count_col(db, t):
    return db.select(fn.count(t.o_orderpriority).as_("n"), fn.count().as_("total")).from_(t)


def _rounded(q, *names, digits=2):
    df = q.exec_df()
    return df.withColumns({n: F.round(n, digits) for n in names})


@query("SELECT round(sum(l_extendedprice), 2) AS s, sum(l_linenumber)::bigint AS n FROM lineitem", "lineitem")
def agg_sum(db, t):
    return _rounded(db.select(fn.sum(t.l_extendedprice).as_("s"), fn.sum(t.l_linenumber).as_("n")).from_(t), "s")


@query("SELECT round(avg(l_quantity), 4) AS a FROM lineitem", "lineitem")
def agg_avg(db, t):
    return _rounded(db.select(fn.avg(t.l_quantity).as_("a")).from_(t), "a", digits=4)


@query("SELECT min(l_quantity) AS lo, max(l_extendedprice) AS hi FROM lineitem", "lineitem")
def agg_min_max(db, t):
    return db.select(fn.min(t.l_quantity).as_("lo"), fn.max(t.l_extendedprice).as_("hi")).from_(t)


@query("SELECT min(p_name) AS lo, max(p_name) AS hi FROM part", "part")
def agg_min_max_string(db, t):
    return db.select(fn.min(t.p_name).as_("lo"), fn.max(t.p_name).as_("hi")).from_(t)


@query("SELECT min(o_orderdate) AS lo, max(o_orderdate) AS hi FROM orders", "orders")
def agg_min_max_date(db, t):
    return db.select(fn.min(t.o_orderdate).as_("lo"), fn.max(t.o_orderdate).as_("hi")).from_(t)


@query("SELECT round(stddev_samp(l_quantity), 4) AS sd FROM lineitem", "lineitem")
def agg_stddev(db, t):
    return _rounded(db.select(fn.stddev(t.l_quantity).as_("sd")).from_(t), "sd", digits=4)


@query("SELECT r_name, CASE WHEN count(r_regionkey) = 1 THEN 0.0::double ELSE stddev_samp(r_regionkey) END AS sd FROM region GROUP BY r_name", "region")
def agg_stddev_single(db, t):
    return db.select(t.r_name, fn.stddev(t.r_regionkey).as_("sd")).from_(t).group_by(t.r_name)


@query("SELECT round(exp(avg(CASE WHEN l_discount > 0 THEN ln(l_discount) END)), 6) AS g FROM lineitem", "lineitem")
def agg_geomean(db, t):
    return _rounded(db.select(fn.geomean(t.l_discount).as_("g")).from_(t), "g", digits=6)


@query("SELECT count(*) AS n, sum(l_quantity) AS s, min(l_tax) AS lo FROM lineitem WHERE l_quantity < 0", "lineitem")
def agg_empty(db, t):
    return db.select(fn.count().as_("n"), fn.sum(t.l_quantity).as_("s"), fn.min(t.l_tax).as_("lo")).from_(t).where(t.l_quantity.lt(0.0))


@query(f"SELECT count(p_size) AS n, sum(p_size)::bigint AS s, avg(p_size) AS a FROM {N_PART} WHERE p_size IS NULL", "part", nulls=True)
def agg_all_null(db, t):
    return db.select(fn.count(t.p_size).as_("n"), fn.sum(t.p_size).as_("s"), fn.avg(t.p_size).as_("a")).from_(t).where(t.p_size.is_null())


@query("SELECT DISTINCT l_returnflag AS v FROM lineitem", "lineitem")
def distinct_col(db, t):
    return db.select(fn.distinct(t.l_returnflag).as_("v")).from_(t)


@query(f"SELECT DISTINCT p_size AS v FROM {N_PART}", "part", nulls=True)
def distinct_null(db, t):
    return db.select(fn.distinct(t.p_size).as_("v")).from_(t)


for _name, _sql in (
    ("count", "count(DISTINCT p_size)"), ("sum", "sum(DISTINCT p_size)::bigint"), ("avg", "round(avg(DISTINCT p_size), 4)"), ("stddev", "round(stddev_samp(DISTINCT p_size), 4)"),
    ("geomean", "round(exp(avg(DISTINCT CASE WHEN p_size > 0 THEN ln(p_size) END)), 6)"),
):

    def _agg(db, t, _f=_name):
        q = db.select(getattr(fn, _f)(fn.distinct(t.p_size)).as_("v")).from_(t)
        return q if _f in ("count", "sum") else _rounded(q, "v", digits=6 if _f == "geomean" else 4)

    _agg.__name__ = f"{_name}_distinct"
    query(f"SELECT {_sql} AS v FROM {N_PART}", "part", nulls=True)(_agg)


# --- groups


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus", "orders")
def group_one(db, t):
    return db.select(t.o_orderstatus, fn.count().as_("n")).from_(t).group_by(t.o_orderstatus)


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS q, round(avg(l_discount), 6) AS d, count(*) AS n FROM lineitem GROUP BY ALL", "lineitem")
def group_multi(db, t):
    q = db.select(t.l_returnflag, t.l_linestatus, fn.sum(t.l_quantity).as_("q"), fn.avg(t.l_discount).as_("d"), fn.count().as_("n")).from_(t).group_by(t.l_returnflag, t.l_linestatus)
    return q.exec_df().withColumns({"q": F.round("q", 2), "d": F.round("d", 6)})


@query(f"SELECT o_orderpriority, count(*) AS n FROM {N_ORDERS} GROUP BY o_orderpriority", "orders", nulls=True)
def group_null_key(db, t):
    return db.select(t.o_orderpriority, fn.count().as_("n")).from_(t).group_by(t.o_orderpriority)


@query("SELECT o_totalprice > 150000 AS large, count(*) AS n FROM orders GROUP BY 1", "orders")
def group_bool_key(db, t):
    b = create("flags")
    df = db.tables(["orders"])["orders"].select("o_orderkey", (F.col("o_totalprice") > 150000).alias("large"))
    b.table_from("flags", df)
    other = b.connect(db.spark)
    other.attach("flags", df)
    x = other.table("flags")
    return other.select(x.large, fn.count().as_("n")).from_(x).group_by(x.large)


@query("SELECT o_orderdate, count(*) AS n, max(o_totalprice) AS hi FROM orders GROUP BY o_orderdate", "orders")
def group_date_key(db, t):
    return db.select(t.o_orderdate, fn.count().as_("n"), fn.max(t.o_totalprice).as_("hi")).from_(t).group_by(t.o_orderdate)


@query("SELECT o_custkey, arg_min(o_totalprice, o_orderkey) AS first_price, count(*) AS n FROM orders GROUP BY o_custkey", "orders")
def group_mixed_col(db, t):
    return db.select(t.o_custkey, t.o_totalprice.as_("first_price"), fn.count().as_("n")).from_(t).group_by(t.o_custkey)


@query("SELECT r_name, count(*) AS n, round(sum(c_acctbal), 2) AS s FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name", "customer", "nation", "region")
def group_join(db, c, n, r):
    q = db.select(r.r_name, fn.count().as_("n"), fn.sum(c.c_acctbal).as_("s")).from_(c).inner_join(n, c.c_nationkey.eq(n.n_nationkey)).inner_join(r, n.n_regionkey.eq(r.r_regionkey)).group_by(r.r_name)
    return _rounded(q, "s")


@query("SELECT p_size, count(*) AS n FROM part GROUP BY p_size ORDER BY p_size LIMIT 7", "part")
def group_limit(db, t):
    return db.select(t.p_size, fn.count().as_("n")).from_(t).group_by(t.p_size).order_by(t.p_size).limit(7)


@query("SELECT p_size, count(*) AS n FROM part WHERE p_size > 1000 GROUP BY p_size", "part")
def group_empty(db, t):
    return db.select(t.p_size, fn.count().as_("n")).from_(t).where(t.p_size.gt(1000)).group_by(t.p_size)


# --- order, paging


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice, p_partkey", "part")
def order_asc(db, t):
    return db.select(t.p_partkey, t.p_retailprice).from_(t).order_by(t.p_retailprice).order_by(t.p_partkey)


@query(f"SELECT p_partkey, p_size FROM {N_PART} ORDER BY p_size DESC NULLS LAST, p_partkey", "part", nulls=True)
def order_desc(db, t):
    return db.select(t.p_partkey, t.p_size).from_(t).order_by(t.p_size, Order.DESC).order_by(t.p_partkey)


@query(f"SELECT p_partkey FROM {N_PART} ORDER BY p_brand DESC, p_size NULLS FIRST, p_partkey", "part", nulls=True)
def order_multi(db, t):
    return db.select(t.p_partkey).from_(t).order_by(t.p_brand, Order.DESC).order_by(t.p_size).order_by(t.p_partkey)


@query(f"SELECT p_partkey, p_brand FROM {N_PART} ORDER BY p_brand, p_partkey LIMIT 70 OFFSET 25", "part", nulls=True)
def order_ties_paged(db, t):
    """Rows that tie stay in the order of the table, so that a page over ties is the same each time."""
    return db.select(t.p_partkey, t.p_brand).from_(t).order_by(t.p_brand).limit(70).skip(25)


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, min(o_orderkey) LIMIT 20", "orders")
def order_ties_groups(db, t):
    """Groups that tie stay in the order of their first rows."""
    return db.select(t.o_custkey, fn.count().as_("n")).from_(t).group_by(t.o_custkey).order_by(fn.count(), Order.DESC).limit(20)


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY arg_max(o_totalprice, o_orderkey) DESC, o_custkey LIMIT 15", "orders")
def order_by_last_row(db, t):
    """A column that is not grouped sorts by the group's last row."""
    return db.select(t.o_custkey, fn.count().as_("n")).from_(t).group_by(t.o_custkey).order_by(t.o_totalprice, Order.DESC).order_by(t.o_custkey).limit(15)


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 10", "orders")
def order_by_agg(db, t):
    return db.select(t.o_custkey, fn.count().as_("n")).from_(t).group_by(t.o_custkey).order_by(fn.count(), Order.DESC).order_by(t.o_custkey).limit(10)


@query("SELECT o_custkey FROM orders GROUP BY o_custkey ORDER BY max(o_totalprice) DESC, o_custkey LIMIT 10", "orders")
def order_by_hidden_agg(db, t):
    return db.select(t.o_custkey).from_(t).group_by(t.o_custkey).order_by(fn.max(t.o_totalprice), Order.DESC).order_by(t.o_custkey).limit(10)


@query("SELECT DISTINCT p_brand AS v FROM part ORDER BY v DESC LIMIT 5", "part")
def order_by_distinct(db, t):
    return db.select(fn.distinct(t.p_brand).as_("v")).from_(t).order_by(fn.distinct(t.p_brand), Order.DESC).limit(5)


@query("SELECT p_name FROM part ORDER BY p_retailprice DESC, p_partkey", "part")
def order_nonprojected(db, t):
    return db.select(t.p_name).from_(t).order_by(t.p_retailprice, Order.DESC).order_by(t.p_partkey)


for _name, _limit, _skip in (("limit", 13, None), ("limit_zero", 0, None), ("skip", None, 5), ("skip_zero", None, 0), ("limit_skip", 10, 15)):

    def _page(db, t, _l=_limit, _s=_skip):
        q = db.select(t.n_nationkey, t.n_name).from_(t).order_by(t.n_nationkey)
        q = q if _l is None else q.limit(_l)
        return q if _s is None else q.skip(_s)

    _page.__name__ = _name
    query("SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey" + ("" if _limit is None else f" LIMIT {_limit}") + (f" OFFSET {_skip}" if _skip else ""), "nation")(_page)


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 100", "lineitem")
def topk(db, t):
    return db.select(t.l_orderkey, t.l_linenumber, t.l_extendedprice).from_(t).order_by(t.l_extendedprice, Order.DESC).order_by(t.l_orderkey).order_by(t.l_linenumber).limit(100)


# --- changes of rows


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT * FROM (VALUES (100, 'NORTH'), (101, 'SOUTH'))", "region")
def dml_insert(db, r):
    db.insert().into(r).values([{"r_regionkey": 100, "r_name": "NORTH"}, {"r_regionkey": 101, "r_name": "SOUTH"}]).exec()
    return db.snapshot(r)


@query("SELECT row_number() OVER (ORDER BY n_nationkey) AS id, n_name AS name FROM nation", "nation")
def dml_autoinc(db, n):
    b = create("ids")
    b.create_table("people").add_column("id", Type.INTEGER).add_column("name", Type.STRING).add_primary_key(["id"], True)
    other = b.connect(db.spark)
    t = other.table("people")
    other.insert().into(t).values([{"id": 0, "name": r["n_name"]} for r in db.select(n.n_name).from_(n).order_by(n.n_nationkey).exec()]).exec()
    return other.snapshot(t)


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey NOT IN (3, 4) UNION ALL SELECT * FROM (VALUES (3, 'NEW', 1), (4, 'NEWER', 2), (77, 'ADDED', 3))", "nation")
def dml_upsert(db, n):
    db.insert_or_replace().into(n).values([{"n_nationkey": k, "n_name": v, "n_regionkey": g} for k, v, g in ((3, "NEW", 1), (4, "OLD", 9), (77, "ADDED", 3), (4, "NEWER", 2))]).exec()
    return db.snapshot(n)


@query("SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_mktsegment = 'BUILDING' AND c_acctbal < 0 THEN 0.0::double ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer", "customer")
def dml_update(db, c):
    db.update(c).set(c.c_acctbal, 0.0).where(op.and_(c.c_mktsegment.eq("BUILDING"), c.c_acctbal.lt(0.0))).exec()
    return db.snapshot(c)


@query("SELECT * FROM orders WHERE NOT (o_orderstatus = 'F' AND o_totalprice < 100000)", "orders")
def dml_delete(db, o):
    db.delete().from_(o).where(op.and_(o.o_orderstatus.eq("F"), o.o_totalprice.lt(100000.0))).exec()
    return db.snapshot(o)


@query("SELECT count(*) AS n FROM region WHERE false", "region")
def dml_delete_all(db, r):
    db.delete().from_(r).exec()
    return db.select(fn.count().as_("n")).from_(r)


def _linked(db, action):
    """region and nation with a foreign key between them."""
    b = create("keys")
    b.create_table("region").add_column("r_regionkey", Type.INTEGER).add_column("r_name", Type.STRING).add_primary_key(["r_regionkey"])
    b.create_table("nation").add_column("n_nationkey", Type.INTEGER).add_column("n_name", Type.STRING).add_column("n_regionkey", Type.INTEGER).add_primary_key(["n_nationkey"]).add_foreign_key("fk", "n_regionkey", "region.r_regionkey", action)
    other = b.connect(db.spark)
    for n in ("region", "nation"):
        df = db.snapshot(db.table(n))
        other.attach(n, df.select(*(F.col(f.name).cast("long").alias(f.name) if f.name.endswith("key") else F.col(f.name) for f in df.schema.fields)))
    return other, other.table("region"), other.table("nation")


@query("SELECT n_nationkey::bigint AS n_nationkey, n_name, n_regionkey::bigint AS n_regionkey FROM nation WHERE n_regionkey <> 2", "region", "nation")
def fk_cascade_delete(db, r, n):
    other, r, n = _linked(db, ConstraintAction.CASCADE)
    other.delete().from_(r).where(r.r_regionkey.eq(2)).exec()
    return other.snapshot(n)


@query("SELECT n_nationkey::bigint AS n_nationkey, n_name, CASE WHEN n_regionkey = 2 THEN 42 ELSE n_regionkey END::bigint AS n_regionkey FROM nation", "region", "nation")
def fk_cascade_update(db, r, n):
    other, r, n = _linked(db, ConstraintAction.CASCADE)
    other.update(r).set(r.r_regionkey, 42).where(r.r_regionkey.eq(2)).exec()
    return other.snapshot(n)


def _refused(f) -> int:
    """The number of the error that ``f`` ends with; 0 if it does not."""
    try:
        f()
    except EngineError as e:
        return e.code
    return 0


@query("SELECT n_nationkey::bigint AS n_nationkey, 203 AS code FROM nation", "region", "nation")
def fk_restrict_delete(db, r, n):
    """A restricting child stops the deletion, and all rows stay."""
    other, r, n = _linked(db, ConstraintAction.RESTRICT)
    code = _refused(other.delete().from_(r).where(r.r_regionkey.eq(2)).exec)
    return other.snapshot(n).select("n_nationkey", F.lit(code).alias("code"))


@query("SELECT 203 AS code, count(*) AS n FROM nation", "region", "nation")
def fk_restrict_insert(db, r, n):
    other, r, n = _linked(db, ConstraintAction.RESTRICT)
    code = _refused(other.insert().into(n).values([{"n_nationkey": 900, "n_name": "X", "n_regionkey": 901}]).exec)
    return other.snapshot(n).agg(F.lit(code).alias("code"), F.count(F.lit(1)).alias("n"))


def _late(db):
    """region and nation with a foreign key that is checked at the end of a transaction."""
    b = create("late")
    b.create_table("region").add_column("id", Type.INTEGER).add_primary_key(["id"])
    b.create_table("nation").add_column("id", Type.INTEGER).add_column("region", Type.INTEGER).add_primary_key(["id"]).add_foreign_key("fk", "region", "region.id", timing=ConstraintTiming.DEFERRABLE)
    other = b.connect(db.spark)
    return other, other.table("region"), other.table("nation")


@query("SELECT 0 AS code, r_regionkey::bigint AS id FROM region", "region", "nation")
def fk_deferrable_commit(db, r, n):
    """Children come before their parents within one transaction."""
    other, r2, n2 = _late(db)
    rows = db.select(n.n_nationkey.as_("id"), n.n_regionkey.as_("region")).from_(n).exec_df()
    parents = db.select(r.r_regionkey.as_("id")).from_(r).exec_df()
    code = _refused(lambda: other.create_transaction().exec([other.insert().into(n2).values(rows), other.insert().into(r2).values(parents)]))
    return other.snapshot(r2).select(F.lit(code).alias("code"), "id")


@query("SELECT 203 AS code, 0::bigint AS n FROM region LIMIT 1", "region", "nation")
def fk_deferrable_refused(db, r, n):
    other, _, n2 = _late(db)
    rows = db.select(n.n_nationkey.as_("id"), n.n_regionkey.as_("region")).from_(n).exec_df()
    code = _refused(other.insert().into(n2).values(rows).exec)
    return other.snapshot(n2).agg(F.lit(code).alias("code"), F.count(F.lit(1)).alias("n"))


def _keyed(db, p, *unique):
    b = create("keyed")
    b.create_table("t").add_column("id", Type.INTEGER).add_column("a", Type.INTEGER).add_column("b", Type.INTEGER).add_primary_key(["id"]).add_nullable(["a", "b"]).add_unique("uq", list(unique))
    other = b.connect(db.spark)
    return other, other.table("t"), db.snapshot(p).selectExpr("p_partkey id", "case when p_partkey % 3 = 0 then p_partkey end a", "cast(null as bigint) b")


@query("SELECT 0 AS code, count(*) AS n FROM part", "part")
def unique_null_one_column(db, p):
    """Nulls in a unique column do not clash."""
    other, t, rows = _keyed(db, p, "a")
    code = _refused(other.insert().into(t).values(rows).exec)
    return other.snapshot(t).agg(F.lit(code).alias("code"), F.count(F.lit(1)).alias("n"))


@query("SELECT 201 AS code, 0::bigint AS n FROM part LIMIT 1", "part")
def unique_null_two_columns(db, p):
    """Keys of several columns clash if all values are the same, nulls included."""
    other, t, rows = _keyed(db, p, "a", "b")
    code = _refused(other.insert().into(t).values(rows).exec)
    return other.snapshot(t).agg(F.lit(code).alias("code"), F.count(F.lit(1)).alias("n"))


@query("SELECT 526 AS code, count(*) AS n FROM part", "part")
def group_missing_error(db, p):
    """A plain column beside an aggregate needs grouping."""
    code = _refused(db.select(p.p_name, fn.count()).from_(p).exec_df)
    return db.snapshot(p).agg(F.lit(code).alias("code"), F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)", "orders", "customer")
def fk_violations(db, o, c):
    parents = db.select().from_(c).where(c.c_acctbal.gte(0.0)).exec_df()
    return orphans(db.select(o.o_orderkey, o.o_custkey).from_(o).exec_df(), ForeignKey("orders.customer", "orders", "o_custkey", "customer", "c_custkey"), parents)


@query("SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1", "lineitem")
def unique_violations(db, t):
    return repeated_keys(db.snapshot(t), ["l_orderkey", "l_partkey"])


@query(f"SELECT o_orderkey FROM {N_ORDERS} WHERE o_orderpriority IS NULL OR o_custkey IS NULL", "orders", nulls=True)
def notnull_violations(db, t):
    return null_rows(db.snapshot(t), ["o_orderpriority", "o_custkey"]).select("o_orderkey")


# --- transactions, live queries, text


def _changed(db, r):
    tx = db.create_transaction()
    tx.begin([r])
    tx.attach(db.insert().into(r).values([{"r_regionkey": 50, "r_name": "FIFTY"}]))
    tx.attach(db.update(r).set(r.r_name, "ZERO").where(r.r_regionkey.eq(0)))
    return tx


@query("SELECT r_regionkey, CASE WHEN r_regionkey = 0 THEN 'ZERO' ELSE r_name END AS r_name FROM region UNION ALL SELECT 50, 'FIFTY'", "region")
def tx_commit(db, r):
    _changed(db, r).commit()
    return db.snapshot(r)


@query("SELECT r_regionkey, r_name FROM region", "region")
def tx_rollback(db, r):
    _changed(db, r).rollback()
    return db.snapshot(r)


@query("SELECT count(*) + 1 AS n FROM region", "region")
def tx_read_own_writes(db, r):
    tx = _changed(db, r)
    seen = tx.attach(db.select(fn.count().as_("n")).from_(r))
    tx.rollback()
    return db.spark.createDataFrame([(seen[0]["n"],)], "n long")


@query("SELECT r_regionkey::bigint AS id, r_name AS name FROM region WHERE r_regionkey <= 2 UNION ALL SELECT 100 + n_nationkey, CASE WHEN n_nationkey > 9 THEN 'NONE' ELSE n_name END FROM nation", "region", "nation")
def tx_concurrent(db, r, n):
    """Two transactions on different tables are open at once; both commits stay."""
    one, two = db.create_transaction(), db.create_transaction()
    one.begin([r]), two.begin([n])
    one.attach(db.delete().from_(r).where(r.r_regionkey.gt(2)))
    one.commit()
    two.attach(db.update(n).set(n.n_name, "NONE").where(n.n_nationkey.gt(9)))
    two.commit()
    rest = db.snapshot(r).selectExpr("cast(r_regionkey as bigint) id", "r_name name")
    return rest.unionByName(db.snapshot(n).selectExpr("cast(100 + n_nationkey as bigint) id", "n_name name"))


@query("SELECT true AS success, 1::bigint AS inserted, count(*) FILTER (r_regionkey > 2)::bigint AS updated, count(*) FILTER (r_regionkey < 2)::bigint AS deleted, 1::bigint AS tables FROM region", "region")
def tx_stats(db, r):
    tx = db.create_transaction()
    tx.exec([db.insert().into(r).values([{"r_regionkey": 2000, "r_name": "NEW"}]), db.update(r).set(r.r_name, "X").where(r.r_regionkey.between(3, 1999)), db.delete().from_(r).where(r.r_regionkey.lt(2))])
    s = tx.stats()
    return db.spark.createDataFrame([(s.success, s.inserted_row_count, s.updated_row_count, s.deleted_row_count, s.changed_table_count)], "success boolean, inserted long, updated long, deleted long, tables long")


@query("SELECT 'removed' AS change, n_name FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'added', 'LATE'", "nation")
def observer_splices(db, n):
    """What an observer of an ordered result is told about two commits."""
    seen: list = []
    q = db.select(n.n_name).from_(n).where(n.n_regionkey.lte(1)).order_by(n.n_nationkey)
    db.observe(q, seen.extend)
    q.exec()
    seen.clear()
    db.delete().from_(n).where(n.n_regionkey.eq(1)).exec()
    db.insert().into(n).values([{"n_nationkey": 999, "n_name": "LATE", "n_regionkey": 0}]).exec()
    told = [("removed", x["n_name"]) for c in seen for x in c["removed"]] + [("added", c["object"][c["index"]]["n_name"]) for c in seen if c["added_count"]]
    return db.spark.createDataFrame(told, "change string, n_name string")


@query(
    "SELECT 'added' AS change, c_custkey, 0.0::double AS c_acctbal FROM customer WHERE c_acctbal < -500 UNION ALL SELECT 'removed', c_custkey, c_acctbal FROM customer WHERE c_acctbal < -500", "customer"
)
def observer_diff(db, c):
    watched = db.select(c.c_custkey, c.c_acctbal).from_(c)
    before = watched.exec_df()
    db.update(c).set(c.c_acctbal, 0.0).where(c.c_acctbal.lt(-500.0)).exec()
    added, removed = result_diff(before, watched.exec_df())
    return added.select(F.lit("added").alias("change"), "*").unionByName(removed.select(F.lit("removed").alias("change"), "*"))


@query("SELECT n_regionkey, count(*) AS n FROM nation WHERE n_name NOT LIKE '%2' GROUP BY n_regionkey ORDER BY n DESC, n_regionkey LIMIT 4", "nation")
def to_sql_roundtrip(db, n):
    q = db.select(n.n_regionkey, fn.count().as_("n")).from_(n).where(op.not_(n.n_name.match("2$"))).group_by(n.n_regionkey).order_by(fn.count(), Order.DESC).order_by(n.n_regionkey).limit(4)
    db.snapshot(n).createOrReplaceTempView("nation")
    return db.spark.sql(q.to_sql())


@query("SELECT r_regionkey::bigint AS r_regionkey, r_name FROM region", "region", "nation")
def export_import_roundtrip(db, r, n):
    source, _, _ = _linked(db, ConstraintAction.RESTRICT)
    target, r2, _ = _linked(db, ConstraintAction.RESTRICT)
    for t in target.schema.tables:
        target.states[t] = target.store.state(t)
    target.import_(source.export())
    return target.snapshot(r2)


@query("SELECT n_nationkey::bigint AS id, n_name AS label, 'x' AS tag FROM nation", "nation")
def upgrade_add_drop_rename(db, n):
    from .sources.files import shared_dir

    path = f"{shared_dir(db.spark)}/upgrade-{id(db)}-{dt.datetime.now().timestamp()}"
    old = create("v", 1)
    old.create_table("t").add_column("id", Type.INTEGER).add_column("name", Type.STRING).add_column("region", Type.INTEGER).add_primary_key(["id"])
    one = old.connect(db.spark, store="parquet", path=path)
    one.insert().into(one.table("t")).values(db.snapshot(n).selectExpr("n_nationkey id", "n_name name", "n_regionkey region")).exec()
    one.close()
    new = create("v", 2)
    new.create_table("t").add_column("id", Type.INTEGER).add_column("label", Type.STRING).add_column("tag", Type.STRING).add_primary_key(["id"])

    def upgrade(raw):
        raw.drop_table_column("t", "region")
        raw.rename_table_column("t", "name", "label")
        raw.add_table_column("t", "tag", "x")

    two = new.connect(db.spark, store="parquet", path=path, on_upgrade=upgrade)
    return two.snapshot(two.table("t"))


def flagship(db, c, o):
    return db.select(c.c_mktsegment, fn.count().as_("n"), fn.sum(o.o_totalprice).as_("total")).from_(o).inner_join(c, o.o_custkey.eq(c.c_custkey)).where(o.o_orderstatus.neq("P")).group_by(c.c_mktsegment).order_by(c.c_mktsegment)


@query("SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'P' GROUP BY c_mktsegment", "customer", "orders")
def segment_totals(db, c, o):
    return _rounded(flagship(db, c, o), "total")
