"""Integrity checks: each gives the rows that violate; a statement stops at the first one found."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import EngineError
from ..schema import DatabaseSchema, ForeignKey, Table
from ..types import ConstraintTiming


def null_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with a null in any of ``columns``."""
    return df.filter(reduce(lambda a, b: a | b, (F.col(c).isNull() for c in columns))) if columns else df.limit(0)


def repeated_keys(df: DataFrame, columns: list[str]) -> DataFrame:
    """(columns, n) of keys that more than one row has; nulls count only in keys of several columns, where they tie."""
    if len(columns) == 1:
        df = df.filter(F.col(columns[0]).isNotNull())
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def orphans(child: DataFrame, fk: ForeignKey, parent: DataFrame) -> DataFrame:
    """Rows of the child whose key is not null and has no parent."""
    keys = parent.select(F.col(fk.parent_column).alias("__parent"))
    return child.filter(F.col(fk.child_column).isNotNull()).join(keys, F.col(fk.child_column) == F.col("__parent"), "left_anti")


def check_nulls(table: Table, new: DataFrame) -> None:
    if not table.not_null:
        return
    bad = null_rows(new, table.not_null).first()
    if bad is not None:
        raise EngineError(202, f"{table.name}.{next(c for c in table.not_null if bad[c] is None)}")


def check_unique(table: Table, after: DataFrame, changed: DataFrame | None = None) -> None:
    """``changed``: the new rows, if only their keys can repeat; then ``after`` is cut to those keys first."""
    for index in table.unique_keys():
        columns = [c.name for c in index.columns]
        rows = after.select(*columns)
        if changed is not None:
            keys = changed.select(*(F.col(c).alias(f"__{c}") for c in columns)).distinct()
            rows = rows.join(keys, reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in columns)), "left_semi")
        if (bad := repeated_keys(rows, columns).first()) is not None:
            raise EngineError(201, f"{table.name}.{index.name} {[bad[c] for c in columns]}")


def check_children(schema: DatabaseSchema, name: str, changed: DataFrame, tables: dict, timing: ConstraintTiming | None = None) -> None:
    """New or changed rows of a child must have parents."""
    for fk in schema.table(name).foreign_keys:
        if timing in (None, fk.timing) and orphans(changed, fk, tables[fk.parent_table]).first() is not None:
            raise EngineError(203, fk.name)


def check_parents(fks: list[ForeignKey], gone: DataFrame, tables: dict) -> None:
    """Rows that left a parent must not be referred to."""
    for fk in fks:
        keys = gone.select(F.col(fk.parent_column).alias("__gone")).filter("__gone is not null").distinct()
        if tables[fk.child_table].join(keys, F.col(fk.child_column) == F.col("__gone"), "left_semi").first() is not None:
            raise EngineError(203, fk.name)


