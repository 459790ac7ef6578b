"""Database: the handle for queries, transactions, live queries, export and import."""

from __future__ import annotations

import json
import threading
from dataclasses import dataclass

from pyspark.sql import Column as Col
from pyspark.sql import DataFrame, SparkSession

from .errors import EngineError
from .locks import LockManager, Priority, TransactionState
from .operators import dml
from .operators.constraints import check_children, check_parents
from .query import DeleteBuilder, InsertBuilder, SelectBuilder, UpdateBuilder
from .schema import ROW_ID, DatabaseSchema, Table
from .sources.store import State, Store
from .sources.upgrade import RawStore, describe
from .streaming.observe import Observers
from .types import ConstraintAction, ConstraintTiming, DataStoreType, TransactionType


@dataclass(frozen=True)
class TransactionStats:
    success: bool
    inserted_row_count: int = 0
    updated_row_count: int = 0
    deleted_row_count: int = 0
    changed_table_count: int = 0


def plain(x):
    """A collected row as nested dicts."""
    return x.asDict(recursive=True)


class Database:
    """``store`` is memory, parquet or json; the latter two need ``path``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, schema: DatabaseSchema, store=DataStoreType.MEMORY, path: str | None = None, on_upgrade=None):
        self.spark, self.schema = spark, schema
        kind = DataStoreType(store)
        if kind is not DataStoreType.MEMORY and path is None:
            raise EngineError(300)
        self.store = Store(spark, None if kind is DataStoreType.MEMORY else path, "json" if kind is DataStoreType.JSON else "parquet")
        self.locks, self.observers, self.open, self.on_close = LockManager(), Observers(), True, None
        self._commits, self._cached = threading.RLock(), {}
        if self.store.number >= 0 and self.store.version > schema.version:
            raise EngineError(108)
        if self.store.number >= 0 and self.store.version < schema.version:
            raw = RawStore(self.store)
            if on_upgrade:
                on_upgrade(raw)
            raw.finish(schema)
        self.states: dict[str, State] = {t: self.store.state(t) for t in schema.tables}
        if self.store.number < 0:
            self.store.commit(schema.name, schema.version, self.states, describe(schema))

    # --- tables

    def get_schema(self) -> DatabaseSchema:
        return self.schema

    def table(self, name: str) -> Table:
        return self.schema.table(name)

    def attach(self, name: str, df: DataFrame, row_id: Col | None = None) -> Database:
        """Makes a DataFrame a table's rows, without a copy; constraints are not checked.  ``row_id`` orders the rows."""
        self._alive()
        df = df if row_id is None else df.withColumn(ROW_ID, row_id)
        self.states[self.schema.table(name).name] = State((), None, None, df)
        return self

    def tables(self, names) -> dict[str, DataFrame]:
        self._alive()
        return {n: self._rows(n) for n in names}

    def _rows(self, name: str) -> DataFrame:
        state, kept = self.states[name], self._cached.get(name)
        if kept is not None and kept[0] is not state:  # the table has changed: its rows are cached anew
            kept[1].unpersist()
            kept = self._cached[name] = (state, self.store.read(self.schema.table(name), state).persist())
        return self.store.read(self.schema.table(name), state) if kept is None else kept[1]

    def cache(self, *tables: Table) -> Database:
        """Keeps the tables' rows with the executors, as far as they fit, until ``uncache``; later snapshots too."""
        self._alive()
        for t in tables:
            if t.name not in self._cached:
                state = self.states[t.name]
                self._cached[t.name] = (state, self.store.read(self.schema.table(t.name), state).persist())
        return self

    def uncache(self, *tables: Table) -> None:
        for t in tables or [self.schema.table(n) for n in list(self._cached)]:
            if kept := self._cached.pop(t.name, None):
                kept[1].unpersist()

    def compact(self, table: Table) -> None:
        """Writes a table's segments as one and removes all that no longer belong to it.

        Nobody may read older snapshots of it any more, and no other handle may write to it meanwhile.
        """
        tx = self.create_transaction()
        tx.begin([table])
        try:
            state = tx._work.states[table.name]
            if len(state.paths) > 1 and state.external is None:
                tx._work.put(table.name, tx._work.rewritten(table, state, self.store.read(table, state)))
            self._commit(tx._work, tx._scope)
            self.store.discard(self.store.segments(table.name) - set(self.states[table.name].paths))
        finally:
            tx._work.changed.clear(), tx._work.written.clear()
            tx.rollback()

    def snapshot(self, table: Table) -> DataFrame:
        """The table's rows now, without the row id."""
        return self.tables([table.name])[table.name].select(*(c.name for c in table.columns))

    # --- statements

    def select(self, *columns) -> SelectBuilder:
        self._alive()
        return SelectBuilder(self, columns)

    def insert(self) -> InsertBuilder:
        self._alive()
        return InsertBuilder(self)

    def insert_or_replace(self) -> InsertBuilder:
        self._alive()
        return InsertBuilder(self, replace=True)

    def update(self, table: Table) -> UpdateBuilder:
        self._alive()
        return UpdateBuilder(self, table)

    def delete(self) -> DeleteBuilder:
        self._alive()
        return DeleteBuilder(self)

    def create_transaction(self, kind: TransactionType = TransactionType.READ_WRITE, priority: Priority = Priority.TRANSACTION) -> Transaction:
        self._alive()
        return Transaction(self, kind, priority)

    def _run_alone(self, query):
        if isinstance(query, SelectBuilder):
            rows = [plain(r) for r in query.exec_df(nested=True).collect()]
            self.observers.update(query, rows)
            return rows
        return self.create_transaction().exec([query])[0]

    def _alive(self) -> None:
        if not self.open:
            raise EngineError(2)

    # --- live queries

    def observe(self, query: SelectBuilder, callback) -> None:
        self._alive()
        self.observers.add(query, callback)

    def observe_frames(self, query: SelectBuilder, callback) -> None:
        """For large results: after a commit ``callback`` gets (added, removed) rows as lazy DataFrames; nothing is collected."""
        self._alive()
        self.observers.add_frames(query, callback, query.exec_df())

    def unobserve(self, query: SelectBuilder, callback) -> None:
        self._alive()
        self.observers.remove(query, callback)

    def _notify(self, changed: set[str]) -> None:
        for query in self.observers.touched(changed):
            self._run_alone(query)
        self.observers.update_frames(changed)

    # --- export, import

    def export(self) -> dict:
        """All rows as plain values; for a database that fits the driver.  ``export_to`` is for larger ones."""
        self._alive()
        return {"name": self.schema.name, "version": self.schema.version, "tables": {n: [json.loads(x) for x in self.snapshot(t).toJSON().collect()] for n, t in self.schema.tables.items()}}

    def export_to(self, folder: str) -> None:
        self._alive()
        for n, t in self.schema.tables.items():
            self.snapshot(t).write.json(f"{folder}/{n}")

    def import_(self, data: dict) -> None:
        """``export``'s result into an empty database of the same name and version; constraints are not checked."""
        self._import(data.get("name"), data.get("version"), data.get("tables"), lambda n, t: self.spark.createDataFrame([(json.dumps(r),) for r in data["tables"][n]], "j string").selectExpr(f"from_json(j, '{t.struct().simpleString()[7:-1].replace(':', ' ')}') r").select("r.*") if data["tables"][n] else None)

    def import_from(self, folder: str, name: str, version: int) -> None:
        self._import(name, version, {n: folder for n in self.schema.tables}, lambda n, t: self.spark.read.schema(t.struct()).json(f"{folder}/{n}"))

    def _import(self, name, version, tables, rows) -> None:
        self._alive()
        if any(self.snapshot(t).first() is not None for t in self.schema.tables.values()):
            raise EngineError(110)
        if (name, version) != (self.schema.name, self.schema.version):
            raise EngineError(111)
        if tables is None:
            raise EngineError(112)
        work = dml.Work(self, self.states)
        for n in tables:
            t = self.schema.table(n)
            df = rows(n, t)
            if df is not None:
                new, state, made = dml._new_rows(work, t, df)
                work.put(n, state)
        self._commit(work, set(self.schema.tables))

    def refresh(self) -> None:
        """Takes over what other handles have committed to the store."""
        if self.store.temporary:
            return
        with self._commits:
            self.store.reload()
            if self.store.version != self.schema.version:
                raise EngineError(108)
            self._take({})

    def _take(self, mine: dict) -> None:
        """The store's tables as of its manifest, but for attached ones; then ``mine``."""
        theirs = {} if self.store.temporary else {t: self.store.state(t) for t, s in self.states.items() if s.external is None and t not in mine}
        self.states = self.states | {t: s for t, s in theirs.items() if s != self.states[t]} | mine

    def _commit(self, work, scope: set[str]) -> None:
        """Only the tables that ``work`` changed are replaced; what others have committed meanwhile stays."""
        if not work.changed:
            return
        with self._commits:
            mine = {n: self.store.stored(self.schema.table(n), work.states[n]) for n in work.changed}
            self.store.commit(self.schema.name, self.schema.version, mine, describe(self.schema), scope, work.base)
            self._take(mine)

    def close(self) -> None:
        self.uncache()
        self.open = False
        self.store.close()
        if self.on_close:
            self.on_close()


class Transaction:
    """``exec`` runs statements as one; ``begin``, ``attach`` and ``commit`` or ``rollback`` do so step by step."""

    def __init__(self, db: Database, kind: TransactionType = TransactionType.READ_WRITE, priority: Priority = Priority.TRANSACTION):
        self.db, self.kind, self.state, self.priority = db, kind, TransactionState(), priority
        self._work, self._scope, self._write = None, set(), True
        self._counts, self._stats = [0, 0, 0], None
        self._deferred: set[str] = set()

    def exec(self, queries: list) -> list:
        self.state.to("EXECUTING_AND_COMMITTING")
        scope, write = set(), False
        try:
            for q in queries:
                q.check()
                scope |= q.scope()
                write |= not isinstance(q, SelectBuilder)
            self._start(scope, write)
            out = [self._one(q) for q in queries]
            self._finish()
        except BaseException:
            self._end(False)
            raise
        self._end(True)
        return out

    def begin(self, tables: list) -> None:
        self.state.to("ACQUIRING_SCOPE")
        names = {t.name for t in tables}
        for n in list(names):  # keys may reach further
            names |= set(self.db.schema.parents(n)) | set(self.db.schema.children(n))
        self._start(names, self.kind is TransactionType.READ_WRITE)
        self.state.to("ACQUIRED_SCOPE")

    def attach(self, query):
        self.state.to("EXECUTING_QUERY")
        try:
            query.check()
            for t in ({i[0].name for i in query.ctx.items} if isinstance(query, SelectBuilder) else query.scope()) - self._scope:
                raise EngineError(106, t)
            out = self._one(query)
        except BaseException:
            self._end(False)
            raise
        self.state.to("ACQUIRED_SCOPE")
        return out

    def commit(self) -> None:
        self.state.to("COMMITTING")
        try:
            self._finish()
        except BaseException:
            self._end(False)
            raise
        self._end(True)

    def rollback(self) -> None:
        self.state.to("ROLLING_BACK")
        self._end(False)

    def stats(self) -> TransactionStats:
        if self._stats is None:
            raise EngineError(105)
        return self._stats

    def _start(self, scope: set[str], write: bool) -> None:
        self.db.locks.acquire(self, scope, write, self.priority)
        self._scope, self._write = scope, write
        if write:
            self.db.refresh()
        self._work = dml.Work(self.db, self.db.states)
        self._before = dict(self.db.states)

    def _one(self, q):
        if isinstance(q, SelectBuilder):
            return [plain(r) for r in q.exec_df(nested=True, tables=self._work.all()).collect()]
        if isinstance(q, InsertBuilder):
            out, *counts = (dml.insert_or_replace if q.replace else dml.insert)(self._work, q)
        else:
            out, *counts = (dml.update if isinstance(q, UpdateBuilder) else dml.delete)(self._work, q)
        self._counts = [a + b for a, b in zip(self._counts, counts, strict=True)]
        return out

    def _finish(self) -> None:
        """Deferred keys are checked on what has changed; then one manifest makes all of it visible."""
        work, schema = self._work, self.db.schema
        for name in work.changed:
            t = schema.table(name)
            columns = [c.name for c in t.columns]
            if any(f.timing is ConstraintTiming.DEFERRABLE for f in t.foreign_keys):
                check_children(schema, name, work.df(name), work.all(), ConstraintTiming.DEFERRABLE)
            late = [f for f in schema.referring(name, ConstraintAction.RESTRICT) if f.timing is ConstraintTiming.DEFERRABLE]
            for f in late:
                was = self.db.store.read(t, self._before[name]).select(*columns)
                now = work.df(name).select(f.parent_column).withColumnRenamed(f.parent_column, "__now")
                check_parents([f], was.join(now, was[f.parent_column] == now["__now"], "left_anti"), work.all())
        self.db._commit(work, self._scope)

    def _end(self, ok: bool) -> None:
        changed = self._work.changed if ok and self._work else set()
        if self._work:
            self._work.discard(failed=not ok)
        self.state.now = "FINALIZED"
        self._stats = TransactionStats(ok, *(self._counts if ok else (0, 0, 0)), len(changed))
        self.db.locks.release(self, self._scope)
        if changed:
            self.db._notify(changed)
