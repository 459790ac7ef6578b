"""INSERT, INSERT OR REPLACE, UPDATE and DELETE: new snapshots from old ones, with integrity checks.

Each function takes the working states of the tables by name and gives (result rows or None, inserted, updated,
deleted); it replaces states only after all immediate checks have passed.
"""

from __future__ import annotations

import uuid
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import EngineError
from ..plans.compile import resolve
from ..predicates import bound
from ..schema import ROW_ID, Table
from ..types import ConstraintAction, ConstraintTiming
from .constraints import check_children, check_nulls, check_parents, check_unique

IMMEDIATE = ConstraintTiming.IMMEDIATE


class Work:
    """Tables in the making: reads see the changes made so far.  ``written``: its segments, which go if it fails."""

    def __init__(self, db, states: dict):
        self.db, self.states, self.base = db, dict(states), dict(db.store.manifest.get("tables", {}))
        self.changed, self.written, self.scratch = set(), set(), set()

    def df(self, name: str) -> DataFrame:
        return self.db.store.read(self.db.schema.table(name), self.states[name])

    def all(self) -> _Tables:
        return _Tables(self)

    def put(self, name: str, state) -> None:
        self.states[name] = state
        self.changed.add(name)

    def write(self, table: Table, df: DataFrame) -> str:
        path = self.db.store.write(table, df)
        self.written.add(path)
        return path

    def rewritten(self, table: Table, state, df: DataFrame):
        out = self.db.store.rewritten(table, state, df)
        self.written.update(out.paths)
        return out

    def parked(self, table: Table, df: DataFrame) -> DataFrame:
        """``df`` written and read back, so that later steps do not compute it again; it goes when the work ends."""
        path = f"{table.name}/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.db.store.root}/{path}")
        self.scratch.add(path)
        return self.db.spark.read.schema(df.schema).parquet(f"{self.db.store.root}/{path}")

    def discard(self, failed: bool) -> None:
        """Removes what no snapshot will name: all that was written if the work failed, else what it replaced itself."""
        used = set() if failed else {p for n in self.changed for p in self.states[n].paths}
        self.db.store.discard((self.written - used) | self.scratch)


class _Tables:
    def __init__(self, work: Work):
        self.work = work

    def __getitem__(self, name: str) -> DataFrame:
        return self.work.df(name)


def _counters(work: Work, table: Table):
    """The state with its counters known; tables that live elsewhere are asked once."""
    s = work.states[table.name]
    if s.next_rid is None or s.max_auto is None:
        df = work.df(table.name)
        auto = table.auto_increment
        rid = F.max(ROW_ID) if ROW_ID in df.columns else F.count(F.lit(1)) - 1
        top, most = df.agg(rid, F.max(auto) if auto else F.lit(0)).first()
        s = replace(s, next_rid=(-1 if top is None else top) + 1, max_auto=most or 0)
    return s


def _new_rows(work: Work, table: Table, rows) -> tuple[DataFrame, object, list[dict] | None]:
    """Incoming rows with row ids and automatic keys; lists give contiguous keys, DataFrames growing ones with gaps."""
    s, auto, db = _counters(work, table), table.auto_increment, work.db
    if isinstance(rows, DataFrame):
        missing = [c for c in table.columns if c.name not in rows.columns]
        df = rows.withColumns({c.name: F.lit(None).cast(table.spark_type(c)) for c in missing}) if missing else rows
        df = df.select(*(F.col(c.name).cast(table.spark_type(c)).alias(c.name) for c in table.columns), F.monotonically_increasing_id().alias(ROW_ID))
        path = work.write(table, df.withColumn(ROW_ID, F.col(ROW_ID) + F.lit(s.next_rid)) if not auto else df.withColumns({auto: F.when(F.coalesce(F.col(auto), F.lit(0)) == 0, F.lit(s.max_auto + 1) + F.col(ROW_ID)).otherwise(F.col(auto)), ROW_ID: F.col(ROW_ID) + F.lit(s.next_rid)}))
        new = db.store.read(table, replace(s, paths=(path,), external=None))
        top, most = new.agg(F.max(ROW_ID), F.max(auto) if auto else F.lit(0)).first()
        return new, replace(s, paths=(*s.paths, path), next_rid=s.next_rid if top is None else top + 1, max_auto=max(s.max_auto, most or 0)), None
    made = [table.create_row(r) for r in rows]
    most = s.max_auto
    if auto:
        for r in made:
            if not r[auto]:
                most += 1
                r[auto] = most
            most = max(most, r[auto])
    new = db.spark.createDataFrame([(*(r[c.name] for c in table.columns), s.next_rid + i) for i, r in enumerate(made)], table.struct().add(ROW_ID, "long"))
    return new, replace(s, next_rid=s.next_rid + len(made), max_auto=most), made


def insert(work: Work, q) -> tuple:
    table = q.table
    new, state, made = _new_rows(work, table, q.rows())
    check_nulls(table, new)
    old = work.df(table.name)
    columns = [c.name for c in table.columns]
    check_unique(table, old.select(*columns).unionByName(new.select(*columns)), new)
    if made is not None:
        state = replace(state, paths=(*state.paths, work.write(table, new)))
    work.put(table.name, state)
    check_children(work.db.schema, table.name, new, work.all(), IMMEDIATE)
    return made, len(made) if made is not None else new.count(), 0, 0


def insert_or_replace(work: Work, q) -> tuple:
    """Rows match by primary key; the last of a batch wins; a replaced row keeps its row id; nothing cascades."""
    table = q.table
    new, state, made = _new_rows(work, table, q.rows())
    check_nulls(table, new)
    pk = [c.name for c in table.primary_key.columns]
    columns = [c.name for c in table.columns]
    last = new.groupBy(*pk).agg(F.max_by(F.struct(*columns, ROW_ID), ROW_ID).alias("r")).select("r.*")
    old = work.df(table.name)
    old = old if ROW_ID in old.columns else old.withColumn(ROW_ID, F.monotonically_increasing_id())
    on = reduce(lambda a, b: a & b, (F.col(c) == F.col(f"__{c}") for c in pk))
    ids = old.select(*(F.col(c).alias(f"__{c}") for c in pk), F.col(ROW_ID).alias("__old"), *(F.col(c).alias(f"__was_{c}") for c in columns if c not in pk))
    merged = last.join(ids, on, "left")
    coming = merged.select(*columns, F.coalesce("__old", ROW_ID).alias(ROW_ID))
    replaced = merged.filter("__old is not null").count()
    gone_keys = last.select(*(F.col(c).alias(f"__{c}") for c in pk))
    stay = old.join(gone_keys, on, "left_anti").select(*columns, ROW_ID)
    after = stay.unionByName(coming)
    check_unique(table, after.select(*columns), coming)
    fks = [f for f in work.db.schema.referring(table.name) if f.timing is IMMEDIATE]
    for f in fks:
        if f.parent_column not in pk:  # a key column other than the primary key may have changed
            lost = merged.filter(F.col("__old").isNotNull() & F.col(f"__was_{f.parent_column}").isNotNull() & ~F.col(f"__was_{f.parent_column}").eqNullSafe(F.col(f.parent_column))).select(F.col(f"__was_{f.parent_column}").alias(f.parent_column))
            check_parents([f], lost, work.all())
    total = made is not None and len(made) or last.count()
    done = work.rewritten(table, state, after)
    work.put(table.name, done)
    check_children(work.db.schema, table.name, coming, work.all(), IMMEDIATE)
    distinct = total if made is None else len({tuple(r[c] for c in pk) for r in made})
    return made, distinct - replaced, replaced, 0


def _matching(q):
    return F.lit(True) if q.predicate is None else F.coalesce(q.predicate.to_column(resolve, q.binds), F.lit(False))


def update(work: Work, q) -> tuple:
    table, db = q.table, work.db
    old = work.df(table.name).alias(table.effective_name)
    hit = _matching(q)
    values = {c.name: bound(v, q.binds) for c, v in q.sets}
    changed = old.filter(hit)
    n = changed.count()
    if not n:
        return None, 0, 0, 0
    lit = {k: F.lit(v).cast(table.spark_type(table[k])) for k, v in values.items()}
    after = old.withColumn("__hit", hit)
    after = after.select(*(F.when(F.col("__hit"), lit[c]).otherwise(F.col(c)).alias(c) if c in lit else F.col(c) for c in after.columns if c != "__hit"), *([] if ROW_ID in after.columns else []), "__hit")
    fresh = after.filter("__hit").drop("__hit")
    check_nulls(table, fresh)
    after = after.drop("__hit")
    columns = [c.name for c in table.columns]
    if any(c.name in values for i in table.unique_keys() for c in i.columns):
        check_unique(table, after.select(*columns), fresh)
    before = dict(work.states)
    work.put(table.name, work.rewritten(table, _counters(work, table), after))
    old_rows = db.store.read(table, before[table.name]).alias(table.effective_name).filter(hit)
    cascaded = 0
    for fk in db.schema.referring(table.name):
        if fk.parent_column in values:
            moved = old_rows.filter(F.col(fk.parent_column).isNotNull() & ~F.col(fk.parent_column).eqNullSafe(lit[fk.parent_column])).select(fk.parent_column).distinct()
            if fk.action is ConstraintAction.CASCADE:
                child = db.schema.table(fk.child_table)
                keys = moved.select(F.col(fk.parent_column).alias("__old"))
                rows = work.df(fk.child_table)
                rows = rows.join(keys, F.col(fk.child_column) == F.col("__old"), "left")
                cascaded += rows.filter("__old is not null").count()
                names = [c for c in rows.columns if c != "__old"]
                rows = rows.select(*(F.when(F.col("__old").isNotNull(), lit[fk.parent_column]).otherwise(F.col(c)).alias(c) if c == fk.child_column else F.col(c) for c in names))
                work.put(fk.child_table, work.rewritten(child, _counters(work, child), rows))
            elif fk.timing is IMMEDIATE:
                check_parents([fk], moved, work.all())
    if any(f.child_column in values for f in table.foreign_keys):
        check_children(db.schema, table.name, fresh, work.all(), IMMEDIATE)
    return None, 0, n + cascaded, 0


def delete(work: Work, q) -> tuple:
    """Rows go, and with them, level by level, the rows of cascading children; restricting children stop it."""
    table, db = q.table, work.db
    old = work.df(table.name).alias(table.effective_name)
    cascades = bool(db.schema.referring(table.name))
    first = old.filter(_matching(q))
    gone = {table.name: [work.parked(table, first) if cascades else first]}
    kept = {table.name: old.filter(~_matching(q))}
    total = gone[table.name][0].count()
    todo = [(table.name, gone[table.name][0])] if total else []
    deleted = total
    while todo:
        name, rows = todo.pop(0)
        for fk in db.schema.referring(name, ConstraintAction.CASCADE):
            keys = rows.select(F.col(fk.parent_column).alias("__gone")).filter("__gone is not null").distinct()
            child = kept.get(fk.child_table)
            child = work.df(fk.child_table) if child is None else child
            on = F.col(fk.child_column) == F.col("__gone")
            lost = work.parked(db.schema.table(fk.child_table), child.join(keys, on, "left_semi"))  # one level's cost, whatever is above it
            if n := lost.count():
                deleted += n
                kept[fk.child_table] = child.join(keys, on, "left_anti")
                gone.setdefault(fk.child_table, []).append(lost)
                todo.append((fk.child_table, lost))
    if not deleted:
        return None, 0, 0, 0
    before = dict(work.states)
    for name, rows in kept.items():
        t = db.schema.table(name)
        state = _counters(work, t)
        work.put(name, replace(state, paths=(), external=None) if name == table.name and q.predicate is None else work.rewritten(t, state, rows))
    for name, parts in gone.items():
        fks = [f for f in db.schema.referring(name, ConstraintAction.RESTRICT) if f.timing is IMMEDIATE]
        for part in parts:
            try:
                check_parents(fks, part, work.all())
            except EngineError:
                work.states.update(before)
                raise
    return None, 0, 0, deleted
