"""Typed, versioned schemas: tables, columns, keys, indices (kept as layout hints) and foreign keys."""

from __future__ import annotations

import copy
import json
import re
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .errors import EngineError
from .predicates import PredicateProvider
from .types import ConstraintAction, ConstraintTiming, Order, Type, type_of

ROW_ID = "__rid"
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def check_name(name: str) -> str:
    if not isinstance(name, str) or not _NAME.fullmatch(name):
        raise EngineError(502, name)
    return name


class Column(PredicateProvider):
    def __init__(self, table: Table, name: str, kind: Type, nullable: bool = False, unique: bool = False, alias: str | None = None):
        self.table, self.name, self.type, self.nullable, self.unique, self.alias = table, name, kind, nullable, unique, alias

    def as_(self, alias: str) -> Column:
        out = copy.copy(self)
        out.alias = alias
        return out

    @property
    def normalized_name(self) -> str:
        return f"{self.table.effective_name}.{self.name}"

    def __repr__(self):
        return f"Column({self.normalized_name}: {self.type.name})"


@dataclass(frozen=True)
class IndexedColumn:
    name: str
    order: Order = Order.ASC
    auto_increment: bool = False


@dataclass(frozen=True)
class Index:
    table: str
    name: str
    unique: bool
    columns: tuple[IndexedColumn, ...]


@dataclass(frozen=True)
class ForeignKey:
    name: str
    child_table: str
    child_column: str
    parent_table: str
    parent_column: str
    action: ConstraintAction = ConstraintAction.RESTRICT
    timing: ConstraintTiming = ConstraintTiming.IMMEDIATE


@dataclass
class Pragma:
    bundled: bool = False


class Table:
    """Columns are attributes (``t.salary``) and items (``t["salary"]``)."""

    def __init__(self, name: str):
        self.name, self.alias = name, None
        self.columns: list[Column] = []
        self.indices: list[Index] = []
        self.primary_key: Index | None = None
        self.foreign_keys: list[ForeignKey] = []
        self.not_null: list[str] = []
        self.persistent_index = False
        self.spark_types: dict[str, T.DataType] = {}

    @property
    def effective_name(self) -> str:
        return self.alias or self.name

    def __getitem__(self, name: str) -> Column:
        for c in self.columns:
            if c.name == name:
                return c
        raise EngineError(508, self.name, name)

    def __getattr__(self, name: str):
        if name.startswith("__") or "columns" not in self.__dict__:
            raise AttributeError(name)
        try:
            return self[name]
        except EngineError:
            raise AttributeError(name) from None

    def as_(self, alias: str) -> Table:
        out = copy.copy(self)
        out.alias = alias
        out.columns = [copy.copy(c) for c in self.columns]
        for c in out.columns:
            c.table = out
        return out

    @property
    def auto_increment(self) -> str | None:
        pk = self.primary_key
        return pk.columns[0].name if pk and pk.columns[0].auto_increment else None

    def unique_keys(self) -> list[Index]:
        return [i for i in self.indices if i.unique]

    def spark_type(self, c: Column) -> T.DataType:
        return self.spark_types.get(c.name, c.type.spark)

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, self.spark_type(c), True) for c in self.columns])

    def create_row(self, values: dict | None = None) -> dict:
        """A row: defaults if nothing is given, else missing fields are null."""
        if values is None:
            return {c.name: None if c.nullable else c.type.default for c in self.columns}
        for k in values:
            self[k]
        out = {c.name: values.get(c.name) for c in self.columns}
        for c in self.columns:
            if c.type is Type.OBJECT and out[c.name] is not None and not isinstance(out[c.name], str):
                out[c.name] = json.dumps(out[c.name], sort_keys=True)
        return out

    def dataframe(self, spark: SparkSession, rows: list[dict]) -> DataFrame:
        return spark.createDataFrame([tuple(self.create_row(r)[c.name] for c in self.columns) for r in rows], self.struct())


class TableBuilder:
    def __init__(self, name: str):
        self.name = check_name(name)
        self._t = Table(name)
        self._columns: dict[str, Type] = {}
        self._nullable: set[str] = set()
        self._unique: dict[str, list[str]] = {}
        self._names: set[str] = set()
        self._indices: dict[str, tuple[bool, list[IndexedColumn]]] = {}
        self._fks: list[ForeignKey] = []
        self._pk: tuple[str, list[IndexedColumn]] | None = None
        self._persistent = False
        self._spark: dict[str, T.DataType] = {}

    def _claim(self, name: str) -> None:
        check_name(name)
        if name == self.name:
            raise EngineError(546, name)
        if name in self._names or name in self._columns:
            raise EngineError(503, f"{self.name}.{name}")
        self._names.add(name)

    def add_column(self, name: str, kind: Type, spark_type: T.DataType | None = None) -> TableBuilder:
        self._claim(name)
        self._columns[name] = kind
        if not kind.keyable:
            self._nullable.add(name)
        if spark_type is not None:
            self._spark[name] = spark_type
        return self

    def _indexed(self, columns, order: Order = Order.ASC) -> list[IndexedColumn]:
        out = [c if isinstance(c, IndexedColumn) else IndexedColumn(c, order) for c in columns]
        for c in out:
            if c.name not in self._columns:
                raise EngineError(508, self.name, c.name)
            if not self._columns[c.name].keyable:
                raise EngineError(509, self.name, c.name)
        return out

    def add_primary_key(self, columns, auto_increment: bool = False) -> TableBuilder:
        cols = self._indexed(columns)
        if auto_increment or any(c.auto_increment for c in cols):
            if len(cols) > 1:
                raise EngineError(505)
            if self._columns[cols[0].name] is not Type.INTEGER:
                raise EngineError(504)
            cols = [replace(cols[0], auto_increment=True)]
        key = "pk" + self.name[0].upper() + self.name[1:]
        self._claim(key)
        self._pk = (key, cols)
        return self

    def add_foreign_key(self, name: str, local: str, ref: str, action=ConstraintAction.RESTRICT, timing=ConstraintTiming.IMMEDIATE) -> TableBuilder:
        self._claim(name)
        if action is ConstraintAction.CASCADE and timing is ConstraintTiming.DEFERRABLE:
            raise EngineError(506)
        if local not in self._columns:
            raise EngineError(540, name)
        parts = ref.split(".")
        if len(parts) != 2:
            raise EngineError(540, name)
        self._fks.append(ForeignKey(f"{self.name}.{name}", self.name, local, *parts, action, timing))
        self._indices[name] = (local in {c for cs in self._unique.values() if len(cs) == 1 for c in cs}, self._indexed([local]))
        return self

    def add_unique(self, name: str, columns) -> TableBuilder:
        self._claim(name)
        self._indices[name] = (True, self._indexed(columns))
        self._unique[name] = list(columns)
        return self

    def add_nullable(self, columns) -> TableBuilder:
        for c in columns:
            if c not in self._columns:
                raise EngineError(508, self.name, c)
        self._nullable |= set(columns)
        return self

    def add_index(self, name: str, columns, unique: bool = False, order: Order = Order.ASC) -> TableBuilder:
        self._claim(name)
        self._indices[name] = (unique, self._indexed(columns, order))
        return self

    def persistent_index(self, value: bool) -> TableBuilder:
        self._persistent = value
        return self

    def build(self) -> Table:
        t, pk = self._t, self._pk
        if pk:
            names = [c.name for c in pk[1]]
            if any(f.child_column in names for f in self._fks):
                raise EngineError(543)
            for n, (unique, cols) in self._indices.items():
                if [c.name for c in cols] == names:
                    raise EngineError(544, f"{self.name}.{n}")
            if self._nullable & set(names):
                raise EngineError(545)
        alone = {cols[0].name for u, cols in [*self._indices.values(), *([(True, pk[1])] if pk else [])] if u and len(cols) == 1}
        t.columns = [Column(t, n, k, n in self._nullable, n in alone) for n, k in self._columns.items()]
        t.indices = [Index(self.name, n, u, tuple(c)) for n, (u, c) in self._indices.items()]
        if pk:
            t.primary_key = Index(self.name, pk[0], True, tuple(pk[1]))
            t.indices.insert(0, t.primary_key)
        t.foreign_keys = list(self._fks)
        t.not_null = [n for n in self._columns if n not in self._nullable]
        t.persistent_index, t.spark_types = self._persistent, dict(self._spark)
        return t


@dataclass
class DatabaseSchema:
    name: str
    version: int
    tables: dict[str, Table] = field(default_factory=dict)
    pragma: Pragma = field(default_factory=Pragma)

    def table(self, name: str) -> Table:
        if name not in self.tables:
            raise EngineError(101, name)
        return self.tables[name]

    def parents(self, name: str) -> list[str]:
        return [f.parent_table for f in self.table(name).foreign_keys]

    def referring(self, name: str, action: ConstraintAction | None = None) -> list[ForeignKey]:
        return [f for t in self.tables.values() for f in t.foreign_keys if f.parent_table == name and action in (None, f.action)]

    def children(self, name: str, action: ConstraintAction | None = None) -> list[str]:
        return [f.child_table for f in self.referring(name, action)]


class SchemaBuilder:
    def __init__(self, name: str, version: int = 1):
        self._schema = DatabaseSchema(name, version)
        self._builders: dict[str, TableBuilder] = {}
        self._final = False
        self._connected = False

    def create_table(self, name: str) -> TableBuilder:
        if self._final:
            raise EngineError(535)
        if name in self._builders:
            raise EngineError(503, name)
        self._builders[name] = TableBuilder(name)
        return self._builders[name]

    def table_from(self, name: str, df: DataFrame, primary_key=(), nullable=()) -> TableBuilder:
        """A table with the columns of a DataFrame."""
        b = self.create_table(name)
        for f in df.schema.fields:
            b.add_column(f.name, type_of(f.dataType), f.dataType)
        if primary_key:
            b.add_primary_key(list(primary_key))
        return b.add_nullable([f.name for f in df.schema.fields if f.name not in primary_key] if nullable == "*" else nullable)

    def set_pragma(self, bundled: bool) -> SchemaBuilder:
        if self._final:
            raise EngineError(535)
        self._schema.pragma = Pragma(bundled)
        return self

    @property
    def schema(self) -> DatabaseSchema:
        if not self._final:
            self._schema.tables = {n: b.build() for n, b in self._builders.items()}
            self._check()
            self._final = True
        return self._schema

    def _check(self) -> None:
        tables = self._schema.tables
        fks = [f for t in tables.values() for f in t.foreign_keys]
        for f in fks:
            parent = tables.get(f.parent_table)
            if parent is None:
                raise EngineError(536, f.name)
            if f.parent_column not in {c.name for c in parent.columns}:
                raise EngineError(537, f.name)
            if parent[f.parent_column].type is not tables[f.child_table][f.child_column].type:
                raise EngineError(538, f.name)
            if not parent[f.parent_column].unique:
                raise EngineError(539, f.name)
        own = {(f.child_table, f.child_column) for f in fks}
        if any((f.parent_table, f.parent_column) in own for f in fks):
            raise EngineError(534)
        edges: dict[str, set[str]] = {}
        for f in fks:
            if f.child_table != f.parent_table:
                edges.setdefault(f.child_table, set()).add(f.parent_table)
        done: set[str] = set()

        def visit(t: str, path: tuple[str, ...]) -> None:
            if t in path:
                raise EngineError(533)
            if t not in done:
                for p in edges.get(t, ()):
                    visit(p, (*path, t))
                done.add(t)

        for t in list(edges):
            visit(t, ())

    def connect(self, spark: SparkSession, **options):
        """A Database; options as of ``Database``."""
        from .database import Database

        if self._connected:
            raise EngineError(113)
        db = Database(spark, self.schema, **options)
        self._connected = True
        db.on_close = lambda: setattr(self, "_connected", False)
        return db


def create(name: str, version: int = 1) -> SchemaBuilder:
    return SchemaBuilder(name, version)
