"""Predicates as immutable trees.

NOT is pushed to the leaves, where it is two-valued: a row whose comparison is unknown passes ``not_``; only NOT IN
drops nulls.  So every leaf is a plain Spark condition that the optimizer can push into scans.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column as Col
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from .errors import EngineError
from .types import ALLOWED, Type


@dataclass(frozen=True)
class Binder:
    """A parameter: the value comes with ``bind``."""

    index: int

    def value(self, given):
        if given is None:
            raise EngineError(501)
        if self.index >= len(given):
            raise EngineError(510)
        return given[self.index]


def bound(x, given):
    if isinstance(x, Binder):
        return x.value(given)
    if isinstance(x, (list, tuple)):
        if any(isinstance(v, Binder) for v in x) and given is None:
            raise EngineError(501)
        return [bound(v, given) for v in x]
    return x


class Predicate:
    def to_column(self, resolve, given=None) -> Col:
        raise NotImplementedError

    def to_sql(self, name, given=None) -> str:
        raise NotImplementedError

    def negate(self) -> Predicate:
        raise NotImplementedError

    def tables(self) -> set[str]:
        raise NotImplementedError


def literal(v) -> str:
    """A Spark SQL literal."""
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).upper()
    if isinstance(v, float):
        return f"double('{v}')" if v != v or v in (float("inf"), float("-inf")) else f"{v!r}D"
    if isinstance(v, int):
        return f"{v}L" if abs(v) > 2**31 - 1 else str(v)
    if isinstance(v, Binder):
        return f"?{v.index}"
    if isinstance(v, (bytes, bytearray)):
        return f"X'{bytes(v).hex().upper()}'"
    if hasattr(v, "isoformat"):
        return f"{'TIMESTAMP_NTZ' if getattr(v, 'tzinfo', None) is None else 'TIMESTAMP'} '{v.isoformat(sep=' ')}'"
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


_COMPARE = {"lt": "<", "lte": "<=", "gt": ">", "gte": ">="}


def _lit(column, v) -> Col:
    """A literal of the column's own kind, so that comparisons stay free of casts of the column."""
    if hasattr(v, "isoformat") and isinstance(column.table.spark_type(column), TimestampNTZType):
        return F.lit(v.isoformat()).cast("timestamp_ntz")
    return F.lit(v)


def _compare(op: str, a: Col, b) -> Col:
    return {"lt": lambda: a < b, "lte": lambda: a <= b, "gt": lambda: a > b, "gte": lambda: a >= b}[op]()


@dataclass(frozen=True)
class ValuePredicate(Predicate):
    column: object
    op: str
    operand: object
    negated: bool = False

    def __post_init__(self):
        kind = self.column.type
        known = self.op in ALLOWED[kind] and not (kind is Type.OBJECT and self.operand is not None)
        if not known:
            raise EngineError(550, kind.name, self.op)

    def negate(self):
        return replace(self, negated=not self.negated)

    def tables(self):
        return {self.column.table.effective_name}

    def _pattern(self, v) -> str:
        if isinstance(v, re.Pattern):
            flags = "".join(f for f, bit in (("i", re.I), ("m", re.M), ("s", re.S)) if v.flags & bit)
            return (f"(?{flags})" if flags else "") + v.pattern
        return v

    def to_column(self, resolve, given=None):
        c, v, op = resolve(self.column), bound(self.operand, given), self.op
        lit = lambda x: _lit(self.column, x)
        if op in ("eq", "neq"):
            if (op == "eq") == self.negated:
                return c.isNotNull() if v is None else ~c.eqNullSafe(lit(v))
            return c.isNull() if v is None else c == lit(v)
        if op == "in":
            among = c.isin([lit(x) for x in v if x is not None]) if any(x is not None for x in v) else F.lit(False)
            return c.isNotNull() & ~among if self.negated else among
        if v is None or op == "between" and None in v:
            return F.lit(self.negated)
        p = c.rlike(self._pattern(v)) if op == "match" else c.between(lit(v[0]), lit(v[1])) if op == "between" else _compare(op, c, lit(v))
        return c.isNull() | ~p if self.negated else p

    def to_sql(self, name, given=None):
        v = bound(self.operand, given) if given is not None else self.operand
        c, op = name(self.column), self.op
        if op in ("eq", "neq"):
            if v is None:
                return f"{c} IS {'NOT ' * ((op == 'eq') == self.negated)}NULL"
            return f"NOT ({c} <=> {literal(v)})" if (op == "eq") == self.negated else f"{c} = {literal(v)}"
        if op == "in":
            listed = ", ".join(literal(x) for x in v if x is not None) if isinstance(v, (list, tuple)) else literal(v)
            if not listed:
                return f"{c} IS NOT NULL" if self.negated else "FALSE"
            return f"({c} IS NOT NULL AND {c} NOT IN ({listed}))" if self.negated else f"{c} IN ({listed})"
        if v is None or op == "between" and isinstance(v, (list, tuple)) and None in v:
            return str(self.negated).upper()
        if op == "match":
            p = f"{c} RLIKE {literal(self._pattern(v))}"
        elif op == "between":
            p = f"{c} BETWEEN {literal(v[0])} AND {literal(v[1])}"
        else:
            p = f"{c} {_COMPARE[op]} {literal(v)}"
        return f"({c} IS NULL OR NOT ({p}))" if self.negated else p


@dataclass(frozen=True)
class JoinPredicate(Predicate):
    """Two columns; null matches nothing, as in SQL."""

    left: object
    right: object
    op: str

    def __post_init__(self):
        if self.op not in ALLOWED[self.left.type] or self.op in ("between", "in", "match"):
            raise EngineError(550, self.left.type.name, self.op)

    def negate(self):
        raise EngineError(300)

    def reverse(self) -> JoinPredicate:
        flip = {"lt": "gt", "gt": "lt", "lte": "gte", "gte": "lte"}
        return JoinPredicate(self.right, self.left, flip.get(self.op, self.op))

    def tables(self):
        return {self.left.table.effective_name, self.right.table.effective_name}

    def to_column(self, resolve, given=None):
        a, b = resolve(self.left), resolve(self.right)
        return a == b if self.op == "eq" else a != b if self.op == "neq" else _compare(self.op, a, b)

    def to_sql(self, name, given=None):
        return f"{name(self.left)} {({'eq': '=', 'neq': '<>'} | _COMPARE)[self.op]} {name(self.right)}"


@dataclass(frozen=True)
class CombinedPredicate(Predicate):
    op: str
    children: tuple

    def negate(self):
        return CombinedPredicate("or" if self.op == "and" else "and", tuple(c.negate() for c in self.children))

    def tables(self):
        return set().union(*(c.tables() for c in self.children))

    def to_column(self, resolve, given=None):
        parts = [c.to_column(resolve, given) for c in self.children]
        return reduce(lambda a, b: a & b if self.op == "and" else a | b, parts)

    def to_sql(self, name, given=None):
        return "(" + f" {self.op.upper()} ".join(c.to_sql(name, given) for c in self.children) + ")"


class PredicateProvider:
    """The predicate methods of a column."""

    def _make(self, op, operand):
        if isinstance(operand, PredicateProvider):
            return JoinPredicate(self, operand, op)
        return ValuePredicate(self, op, tuple(operand) if isinstance(operand, (list, tuple, set)) else operand)

    def eq(self, x):
        return self._make("eq", x)

    def neq(self, x):
        return self._make("neq", x)

    def lt(self, x):
        return self._make("lt", x)

    def lte(self, x):
        return self._make("lte", x)

    def gt(self, x):
        return self._make("gt", x)

    def gte(self, x):
        return self._make("gte", x)

    def match(self, pattern):
        """An unanchored search by a regular expression (text or ``re.Pattern``; flags i, m and s count)."""
        return self._make("match", pattern)

    def between(self, low, high):
        return self._make("between", (low, high))

    def in_(self, values):
        return self._make("in", values)

    def is_null(self):
        return self._make("eq", None)

    def is_not_null(self):
        return self._make("neq", None)
