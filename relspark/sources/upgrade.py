"""Schema upgrades of stored data, and a description of a schema that is kept with it."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import EngineError
from ..schema import ROW_ID, DatabaseSchema, Table
from .store import State, Store


def describe(schema: DatabaseSchema) -> dict:
    return {n: t.struct().jsonValue() for n, t in schema.tables.items()}


class _Stored:
    """Enough of a table for the store."""

    def __init__(self, name: str, struct: T.StructType):
        self.name, self._struct = name, struct

    def struct(self) -> T.StructType:
        return T.StructType(list(self._struct.fields))


class RawStore:
    """Changes of stored tables before a database of a newer version opens; each one writes a table once."""

    def __init__(self, store: Store):
        self._store = store
        self._structs = {n: T.StructType.fromJson(s) for n, s in (store.manifest.get("schema") or {}).items()}
        self._states: dict[str, State] = {n: store.state(n) for n in self._structs}

    def get_version(self) -> int:
        return self._store.version

    def _read(self, name: str) -> DataFrame:
        if name not in self._structs:
            raise EngineError(101, name)
        return self._store.read(_Stored(name, self._structs[name]), self._states[name])

    def _write(self, name: str, df: DataFrame) -> None:
        self._structs[name] = T.StructType([f for f in df.schema.fields if f.name != ROW_ID])
        self._states[name] = replace(self._states[name], paths=(self._store.write(_Stored(name, self._structs[name]), df),))

    def drop_table(self, name: str) -> None:
        self._read(name)
        del self._structs[name], self._states[name]

    def add_table_column(self, table: str, column: str, default, kind: str | None = None) -> None:
        value = F.lit(default) if kind is None else F.lit(default).cast(kind)
        self._write(table, self._read(table).withColumn(column, value))

    def drop_table_column(self, table: str, column: str) -> None:
        self._write(table, self._read(table).drop(column))

    def rename_table_column(self, table: str, old: str, new: str) -> None:
        self._write(table, self._read(table).withColumnRenamed(old, new))

    def create_row(self, table: str, values: dict) -> dict:
        return {f.name: values.get(f.name) for f in self._structs[table].fields}

    def insert(self, table: str, rows: list[dict]) -> None:
        s = self._states[table]
        struct = self._structs[table]
        made = [self.create_row(table, r) for r in rows]
        new = self._store.spark.createDataFrame([(*(r[f.name] for f in struct.fields), s.next_rid + i) for i, r in enumerate(made)], T.StructType([*struct.fields, T.StructField(ROW_ID, T.LongType())]))
        self._states[table] = replace(s, paths=(*s.paths, self._store.write(_Stored(table, struct), new)), next_rid=s.next_rid + len(made))

    def dump(self) -> dict[str, list[dict]]:
        """All rows, for small databases."""
        return {n: [r.asDict(recursive=True) for r in self._read(n).drop(ROW_ID).collect()] for n in self._structs}

    def table(self, name: str) -> DataFrame:
        return self._read(name).drop(ROW_ID)

    def finish(self, schema: DatabaseSchema) -> None:
        """Tables of the new schema keep what was stored; missing columns are null, new tables empty."""
        states = {}
        for n, t in schema.tables.items():
            if n in self._structs:
                have = {f.name for f in self._structs[n].fields}
                if [f.name for f in self._structs[n].fields] != [c.name for c in t.columns]:
                    df = self._read(n)
                    df = df.withColumns({c.name: F.lit(None).cast(t.spark_type(c)) for c in t.columns if c.name not in have}) if any(c.name not in have for c in t.columns) else df
                    self._states[n] = replace(self._states[n], paths=(self._store.write(t, df),))
                states[n] = self._states[n]
            else:
                states[n] = State()
        self._store.commit(schema.name, schema.version, states, describe(schema))


def tables_of(store: Store) -> dict[str, Table]:
    return {n: _Stored(n, T.StructType.fromJson(s)) for n, s in (store.manifest.get("schema") or {}).items()}
