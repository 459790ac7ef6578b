"""Fluent builders of SELECT, INSERT, INSERT OR REPLACE, UPDATE and DELETE."""

from __future__ import annotations

import copy
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from .errors import EngineError
from .functions import Aggregate
from .plans.compile import compile_select, resolve, table_names
from .plans.sql import delete_sql, insert_sql, select_sql, update_sql
from .predicates import Binder, JoinPredicate, Predicate, bound
from .types import Order


@dataclass
class SelectContext:
    columns: list
    items: list = field(default_factory=list)
    where: Predicate | None = None
    group_by: list | None = None
    order_by: list = field(default_factory=list)
    limit: object = None
    skip: object = None
    binds: list | None = None


class Query:
    """What all statements share; ``db`` runs them."""

    def __init__(self, db):
        self.db = db

    def exec(self):
        return self.db._run_alone(self)

    def explain(self) -> str:
        """Spark's plans; for updates and deletes those of the rows that match."""
        kind = type(self).__name__.removesuffix("Builder").lower()
        if isinstance(self, SelectBuilder):
            return self.exec_df()._jdf.queryExecution().toString()
        self.check()
        name = self.table.name
        if isinstance(self, InsertBuilder):
            return f"{'insert_replace' if self.replace else kind}({name})"
        rows = self.db.tables([name])[name].alias(self.table.effective_name)
        rows = rows if self.predicate is None else rows.filter(self.predicate.to_column(resolve, self.binds))
        return f"{kind}({name})\n{rows._jdf.queryExecution().toString()}"

    def clone(self):
        return copy.deepcopy(self, {id(self.db): self.db, **{id(t): t for t in self.db.schema.tables.values()}})


class SelectBuilder(Query):
    def __init__(self, db, columns):
        super().__init__(db)
        self.ctx = SelectContext(list(columns))
        self._from = self._where = False
        distinct = [c for c in columns if isinstance(c, Aggregate) and c.fn == "DISTINCT"]
        if distinct and len(columns) > 1:
            raise EngineError(524)
        for c in columns:
            if isinstance(c, Aggregate):
                c.check()

    def _needs_from(self, code: int) -> None:
        if not self._from:
            raise EngineError(code)

    def from_(self, *tables) -> SelectBuilder:
        if self._from:
            raise EngineError(515)
        self._from = True
        self.ctx.items += [(t, "from", None) for t in tables]
        return self

    def where(self, predicate: Predicate) -> SelectBuilder:
        self._needs_from(548)
        if self._where:
            raise EngineError(516)
        self._where = True
        self.ctx.where = predicate
        return self

    def _join(self, table, kind: str, predicate: Predicate) -> SelectBuilder:
        self._needs_from(542)
        if kind == "left" and not isinstance(predicate, JoinPredicate):
            raise EngineError(541)
        if self._where:
            raise EngineError(547)
        if kind == "left" and predicate.left.table.effective_name == table.effective_name:
            predicate = predicate.reverse()
        self.ctx.items.append((table, kind, predicate))
        return self

    def inner_join(self, table, predicate: Predicate) -> SelectBuilder:
        return self._join(table, "inner", predicate)

    def left_outer_join(self, table, predicate: Predicate) -> SelectBuilder:
        return self._join(table, "left", predicate)

    def _page(self, name: str, n, code: int) -> SelectBuilder:
        if getattr(self.ctx, name) is not None:
            raise EngineError(code)
        if not isinstance(n, Binder) and n < 0:
            raise EngineError(531)
        setattr(self.ctx, name, n)
        return self

    def limit(self, n) -> SelectBuilder:
        return self._page("limit", n, 528)

    def skip(self, n) -> SelectBuilder:
        return self._page("skip", n, 529)

    def order_by(self, column, order: Order = Order.ASC) -> SelectBuilder:
        self._needs_from(549)
        self.ctx.order_by.append((column, order))
        return self

    def group_by(self, *columns) -> SelectBuilder:
        self._needs_from(549)
        if self.ctx.group_by is not None:
            raise EngineError(530)
        self.ctx.group_by = list(columns)
        return self

    def bind(self, values: list) -> SelectBuilder:
        self.ctx.binds = list(values)
        return self

    def check(self) -> None:
        ctx = self.ctx
        if not ctx.items:
            raise EngineError(522)
        for x in (ctx.limit, ctx.skip):
            if isinstance(x, Binder):
                if ctx.binds is None:
                    raise EngineError(523)
                if x.value(ctx.binds) < 0:
                    raise EngineError(531)
        if ctx.group_by is not None:
            if any(isinstance(c, Aggregate) or not c.type.keyable for c in ctx.group_by):
                raise EngineError(525)
        elif {isinstance(c, Aggregate) for c in ctx.columns} == {True, False}:
            raise EngineError(526)

    def exec_df(self, nested: bool = False, tables: dict | None = None) -> DataFrame:
        """The lazy result."""
        self.check()
        return compile_select(self.ctx, tables if tables is not None else self.db.tables(table_names(self.ctx)), nested)

    def scope(self) -> set[str]:
        return table_names(self.ctx)

    def to_sql(self) -> str:
        return select_sql(self.ctx)


class InsertBuilder(Query):
    def __init__(self, db, replace: bool = False):
        super().__init__(db)
        self.replace, self.table, self._values, self.binds = replace, None, None, None

    def into(self, table) -> InsertBuilder:
        if self.table is not None:
            raise EngineError(520)
        if self.replace and table.primary_key is None:
            raise EngineError(519)
        self.table = table
        return self

    def values(self, rows) -> InsertBuilder:
        """A list of dicts, a DataFrame (bulk), a binder for all rows, or a list of binders."""
        if self._values is not None:
            raise EngineError(521)
        self._values = rows
        return self

    def bind(self, values: list) -> InsertBuilder:
        self.binds = list(values)
        return self

    def check(self) -> None:
        if self.table is None or self._values is None:
            raise EngineError(518)

    def rows(self):
        v = self._values
        return v if isinstance(v, DataFrame) else bound(v, self.binds)

    def scope(self) -> set[str]:
        s = self.db.schema
        extra = s.children(self.table.name) if self.replace else []
        return {self.table.name, *s.parents(self.table.name), *extra}

    def to_sql(self) -> str:
        self.check()
        return insert_sql(self.table, self._values if self.binds is None else self.rows(), self.replace)


class UpdateBuilder(Query):
    def __init__(self, db, table):
        super().__init__(db)
        self.table, self.sets, self.predicate, self.binds = table, [], None, None

    def set(self, column, value) -> UpdateBuilder:
        self.sets.append((column, value))
        return self

    def where(self, predicate: Predicate) -> UpdateBuilder:
        if self.predicate is not None:
            raise EngineError(516)
        self.predicate = predicate
        return self

    def bind(self, values: list) -> UpdateBuilder:
        self.binds = list(values)
        return self

    def check(self) -> None:
        if not self.sets:
            raise EngineError(532)
        for _, v in self.sets:
            bound(v, self.binds)

    def scope(self) -> set[str]:
        s = self.db.schema
        return {self.table.name, *s.parents(self.table.name), *s.children(self.table.name)}

    def to_sql(self) -> str:
        return update_sql(self.table, self.sets, self.predicate, self.binds)


class DeleteBuilder(Query):
    def __init__(self, db):
        super().__init__(db)
        self.table, self.predicate, self.binds = None, None, None

    def from_(self, table) -> DeleteBuilder:
        if self.table is not None:
            raise EngineError(515)
        self.table = table
        return self

    def where(self, predicate: Predicate) -> DeleteBuilder:
        if self.table is None:
            raise EngineError(548)
        if self.predicate is not None:
            raise EngineError(516)
        self.predicate = predicate
        return self

    def bind(self, values: list) -> DeleteBuilder:
        self.binds = list(values)
        return self

    def check(self) -> None:
        if self.table is None:
            raise EngineError(517)

    def scope(self) -> set[str]:
        out, todo = set(), [self.table.name]
        while todo:
            t = todo.pop()
            if t not in out:
                out.add(t)
                todo += self.db.schema.children(t)
        return out

    def to_sql(self) -> str:
        self.check()
        return delete_sql(self.table, self.predicate, self.binds)
