"""Versioned tables in a folder: data segments that never change, and numbered manifests that name a snapshot of all tables.

A commit creates the next manifest, which only one writer can do; readers use the manifest they opened.  An insert adds
a segment; updates and deletes write the table anew.  The memory store is such a folder below the shared one that goes
when the database is closed.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import EngineError
from ..schema import ROW_ID, Table
from .files import Files, shared_dir


@dataclass(frozen=True)
class State:
    """One table's snapshot: segments, and rows that live elsewhere (``external``)."""

    paths: tuple[str, ...] = ()
    next_rid: int | None = 0
    max_auto: int | None = 0
    external: DataFrame | None = field(default=None, compare=False)


def stored_struct(table: Table) -> T.StructType:
    return T.StructType([*table.struct().fields, T.StructField(ROW_ID, T.LongType(), True)])


class Store:
    def __init__(self, spark: SparkSession, root: str | None = None, kind: str = "parquet"):
        self.spark, self.kind, self.temporary = spark, kind, root is None
        self.root = (root or f"{shared_dir(spark)}/db-{uuid.uuid4().hex}").rstrip("/")
        if "://" not in self.root and self.root.startswith("/"):
            self.root = f"file://{self.root}" if not spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///").startswith("hdfs") else self.root
        self.files = Files(spark, self.root)
        self.number, self.manifest = -1, {}
        self.reload()

    def reload(self) -> None:
        found = [int(n[9:-5]) for n in self.files.names() if n.startswith("manifest-") and n.endswith(".json")]
        if found:
            self.number = max(found)
            self.manifest = json.loads(self.files.read(f"manifest-{self.number}.json"))

    @property
    def version(self) -> int:
        return self.manifest.get("version", 0)

    def state(self, name: str) -> State:
        t = self.manifest.get("tables", {}).get(name)
        return State(tuple(t["paths"]), t["next_rid"], t["max_auto"]) if t else State()

    def write(self, table: Table, df: DataFrame) -> str:
        """A new segment; its path below the root."""
        path = f"{table.name}/{uuid.uuid4().hex}"
        out = df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in stored_struct(table).fields))
        out.write.format(self.kind).save(f"{self.root}/{path}")
        return path

    def read(self, table: Table, state: State) -> DataFrame:
        parts = []
        if state.external is not None:
            parts.append(state.external)
        if state.paths:
            parts.append(self.spark.read.schema(stored_struct(table)).format(self.kind).load([f"{self.root}/{p}" for p in state.paths]))
        if not parts:
            return self.spark.createDataFrame([], stored_struct(table))
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)

    def stored(self, table: Table, state: State) -> State:
        """``state`` with the rows that live elsewhere written as a segment of its own, which comes first."""
        if state.external is None or self.temporary:
            return state
        rows = state.external
        if ROW_ID not in rows.columns:  # below every id that rows written here have
            rows = rows.withColumn(ROW_ID, F.monotonically_increasing_id() - F.lit(1 << 62))
        return replace(state, paths=(self.write(table, rows), *state.paths), external=None)

    def commit(self, name: str, version: int, states: dict[str, State], schema: dict | None = None, scope: set[str] | None = None, base: dict | None = None) -> None:
        """The next manifest: ``states`` over the tables as they are, or, without a ``scope``, ``states`` alone.

        If another writer was first, this one goes on from that writer's manifest, unless a table of its scope is no longer
        as in ``base``, the tables that it started from.
        """
        if self.temporary:
            return
        mine = {t: {"paths": list(s.paths), "next_rid": s.next_rid, "max_auto": s.max_auto} for t, s in states.items()}
        while True:
            was = self.manifest.get("tables", {})
            if scope is not None and any(was.get(t) != base.get(t) for t in scope | set(mine)):
                raise EngineError(107, "COMMITTING", "FINALIZED: another writer was first")
            made = {"name": name, "version": version, "schema": schema or self.manifest.get("schema"), "tables": mine if scope is None else was | mine}
            if self.files.create(f"manifest-{self.number + 1}.json", json.dumps(made)):
                self.number, self.manifest = self.number + 1, made
                return
            before = self.number
            self.reload()
            if scope is None or self.number == before or self.version != version:
                raise EngineError(107, "COMMITTING", "FINALIZED: another writer was first")

    def rewritten(self, table: Table, state: State, df: DataFrame) -> State:
        if ROW_ID not in df.columns:
            df = df.withColumn(ROW_ID, F.monotonically_increasing_id())
        return replace(state, paths=(self.write(table, df),), external=None)

    def discard(self, paths) -> None:
        """Removes segments that no snapshot names."""
        for p in paths:
            self.files.delete(p)

    def segments(self, name: str) -> set[str]:
        return {f"{name}/{n}" for n in Files(self.spark, f"{self.root}/{name}").names()}

    def close(self) -> None:
        if self.temporary:
            self.files.delete()
