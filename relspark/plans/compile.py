"""SelectContext -> DataFrame.

Joins keep their call order and conditions; filters, pruning, join strategy and skew are Catalyst's, but for equi-joins by
keys that may repeat on both sides (``spread``).  Nothing here collects.  A table's hidden row id, where it has one, decides "first" and "last" of columns that are not grouped, and the
order of rows (or groups: by their first row) that sort keys leave open, so that pages over ties are the same in each run.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column as Col
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import Aggregate
from ..predicates import CombinedPredicate, JoinPredicate, bound
from ..schema import ROW_ID
from ..types import Order
from .aggregates import aggregate_sql
from .spread import spread_join


def text(c) -> str:
    return f"`{c.table.effective_name}`.`{c.name}`"


def resolve(c) -> Col:
    return F.col(text(c))


def output_name(c) -> str:
    return c.alias or c.name


def _conjuncts(p) -> list:
    if p is None:
        return []
    return [x for c in p.children for x in _conjuncts(c)] if isinstance(p, CombinedPredicate) and p.op == "and" else [p]


def _equal(predicates, before: set[str], table) -> list[tuple]:
    """(column of the tables before, column of ``table``, predicate) of what makes the two equal."""
    out, name = [], table.effective_name
    for p in predicates:
        if isinstance(p, JoinPredicate) and p.op == "eq":
            a, b = (p.right, p.left) if p.left.table.effective_name == name else (p.left, p.right)
            if a.table.effective_name in before and b.table.effective_name == name:
                out.append((a, b, p))
    return out


def _keys(table) -> list[frozenset]:
    return [frozenset((table.effective_name, c.name) for c in i.columns) for i in table.indices if i.unique]


def _telling(table, df) -> list[Col]:
    """What tells a table's rows apart: the row id, or else its columns that can be hashed."""
    return [F.col(f"`{table.effective_name}`.`{ROW_ID}`")] if ROW_ID in df.columns else [resolve(c) for c in table.columns if c.type.keyable] or [F.lit(0)]


def _joined(ctx, tables) -> DataFrame:
    """A join by keys that may repeat on both sides is spread; the others are left to Catalyst."""
    df, before, unique, rows = None, set(), [], []
    rest = _conjuncts(ctx.where)
    for table, kind, predicate in ctx.items:
        t, keys, row = tables[table.name].alias(table.effective_name), _keys(table), _telling(table, tables[table.name])
        how = "left" if kind == "left" else "inner"
        equal = _equal(rest if kind == "from" else _conjuncts(predicate), before, table)
        ours, theirs = {(a.table.effective_name, a.name) for a, _, _ in equal}, {(table.effective_name, b.name) for _, b, _ in equal}
        once, alone = any(k <= theirs for k in keys), any(k <= ours for k in unique)
        if df is None:
            df, unique = t, keys
        else:
            if equal and not once and not alone:
                on = reduce(lambda a, b: a & b, (p.to_column(resolve) for _, _, p in equal)) if kind == "from" else predicate.to_column(resolve, ctx.binds)
                df = spread_join(df, t, [(resolve(a), resolve(b)) for a, b, _ in equal], on, how, (rows, row))
                rest = [p for p in rest if kind != "from" or all(p is not q for _, _, q in equal)]
            elif kind == "from":
                df = df.crossJoin(t)
            else:
                df = df.join(t, predicate.to_column(resolve, ctx.binds), how)
            unique = (unique if once else []) + (keys if alone else []) or [a | b for a in unique for b in keys]
        before.add(table.effective_name)
        rows = rows + row
    for p in rest:
        df = df.filter(p.to_column(resolve, ctx.binds))
    return df


def _row_ids(ctx, tables) -> list[Col]:
    ids = [F.col(f"`{t.effective_name}`.`{ROW_ID}`") for t, _, _ in ctx.items if ROW_ID in tables[t.name].columns]
    return ids if len(ids) == len(ctx.items) else []


def _sorted(df: DataFrame, keys: list[tuple[Col, Order]]) -> DataFrame:
    return df.orderBy(*(k.asc_nulls_first() if o is Order.ASC else k.desc_nulls_last() for k, o in keys)) if keys else df


def _paged(ctx, df: DataFrame) -> DataFrame:
    skip, limit = bound(ctx.skip, ctx.binds), bound(ctx.limit, ctx.binds)
    df = df.offset(skip) if skip else df
    return df if limit is None else df.limit(limit)


def compile_select(ctx, tables: dict[str, DataFrame], nested: bool = False) -> DataFrame:
    """``nested``: plain columns of a join come as one struct per table; aliased columns and aggregates stay on top."""
    df = _joined(ctx, tables)
    columns = ctx.columns or [c for t, _, _ in ctx.items for c in t.columns]
    if any(isinstance(c, Aggregate) for c in columns) or ctx.group_by:
        return _grouped(ctx, df, columns, tables)
    ties = [(i, Order.ASC) for i in _row_ids(ctx, tables)] if ctx.order_by else []
    df = _paged(ctx, _sorted(df, [(resolve(c), o) for c, o in ctx.order_by] + ties))
    return df.select(*_projection(ctx, columns, resolve, nested))


def _projection(ctx, columns, value, nested: bool) -> list[Col]:
    several = len(ctx.items) > 1
    if not (nested and several):
        names = [output_name(c) for c in columns]
        twice = {n for n in names if names.count(n) > 1}
        return [value(c).alias(f"{c.table.effective_name}_{c.name}" if n in twice and not c.alias else n) for c, n in zip(columns, names, strict=True)]
    out, done = [], set()
    for c in columns:
        if isinstance(c, Aggregate) or c.alias:
            out.append(value(c).alias(output_name(c)))
        elif c.table.effective_name not in done:
            done.add(c.table.effective_name)
            own = [value(x).alias(x.name) for x in columns if not isinstance(x, Aggregate) and not x.alias and x.table.effective_name == c.table.effective_name]
            out.append(F.struct(*own).alias(c.table.effective_name))
    return out


def _grouped(ctx, df: DataFrame, columns, tables) -> DataFrame:
    if len(columns) == 1 and isinstance(columns[0], Aggregate) and columns[0].fn == "DISTINCT" and not ctx.group_by:
        c = columns[0]
        df = df.select(resolve(c.base).alias(output_name(c))).distinct()
        return _paged(ctx, _sorted(df, [(F.col(f"`{output_name(c)}`"), o) for _, o in ctx.order_by]))
    keys = {k.normalized_name: f"__g{i}" for i, k in enumerate(ctx.group_by or [])}
    ids = _row_ids(ctx, tables)
    order = F.struct(*ids) if ids else None
    made: dict[str, tuple[str, Col]] = {}

    def slot(c, last=False) -> Col:
        if not isinstance(c, Aggregate) and c.normalized_name in keys:
            return F.col(keys[c.normalized_name])
        key = f"{last}:{c.name if isinstance(c, Aggregate) and c.base.name == '*' else aggregate_sql(c, text) if isinstance(c, Aggregate) else c.normalized_name}"
        if key not in made:
            if isinstance(c, Aggregate):
                value = F.expr(aggregate_sql(c, text))
            elif order is None:
                value = F.last(resolve(c)) if last else F.first(resolve(c))
            else:
                value = (F.max_by if last else F.min_by)(resolve(c), order)
            made[key] = (f"__a{len(made)}", value)
        return F.col(made[key][0])

    projected = [slot(c) for c in columns]
    sort = [(slot(c, last=True), o) for c, o in ctx.order_by]
    if sort and order is not None:
        made["ties"] = ("__ties", F.min(order))
        sort.append((F.col("__ties"), Order.ASC))
    values = [v.alias(n) for n, v in made.values()]
    by = df.groupBy(*(resolve(k).alias(keys[k.normalized_name]) for k in ctx.group_by or []))
    df = by.agg(*values) if values else df.select(*(resolve(k).alias(keys[k.normalized_name]) for k in ctx.group_by)).distinct()
    df = _paged(ctx, _sorted(df, sort))
    return df.select(*(v.alias(output_name(c)) for v, c in zip(projected, columns, strict=True)))


def table_names(ctx) -> set[str]:
    return reduce(lambda a, i: a | {i[0].name}, ctx.items, set())
