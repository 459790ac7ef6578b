"""``fn`` (aggregates), ``op`` (logic) and ``bind`` (parameters)."""

from __future__ import annotations

from dataclasses import dataclass, replace

from ..errors import EngineError
from ..predicates import Binder, CombinedPredicate, Predicate
from ..types import Type

NUMERIC = (Type.NUMBER, Type.INTEGER)
FITS = {"SUM": NUMERIC, "AVG": NUMERIC, "STDDEV": NUMERIC, "GEOMEAN": NUMERIC, "MIN": (*NUMERIC, Type.STRING, Type.DATE_TIME), "MAX": (*NUMERIC, Type.STRING, Type.DATE_TIME)}


@dataclass(frozen=True)
class Star:
    """``*``; no predicates."""

    name: str = "*"


@dataclass(frozen=True)
class Aggregate:
    """An aggregate of a column, of a distinct column, or of ``*``; no predicates."""

    fn: str
    child: object
    alias: str | None = None

    def as_(self, alias: str) -> Aggregate:
        return replace(self, alias=alias)

    @property
    def name(self) -> str:
        return f"{self.fn}({self.child.name})"

    @property
    def distinct(self) -> bool:
        return self.fn == "DISTINCT" or isinstance(self.child, Aggregate)

    @property
    def base(self):
        return self.child.base if isinstance(self.child, Aggregate) else self.child

    def check(self) -> None:
        if isinstance(self.base, Star):
            fits = self.fn == "COUNT"
        else:
            fits = self.fn not in FITS or self.base.type in FITS[self.fn]
        if isinstance(self.child, Aggregate) and (self.child.fn != "DISTINCT" or self.fn == "DISTINCT"):
            fits = False
        if not fits:
            raise EngineError(527, self.name)

    def _no(self, *_):
        raise EngineError(500, "a predicate on an aggregate")

    eq = neq = lt = lte = gt = gte = match = between = in_ = is_null = is_not_null = _no


class fn:  # noqa: N801
    @staticmethod
    def count(column=None):
        return Aggregate("COUNT", Star() if column is None else column)

    @staticmethod
    def sum(column):
        return Aggregate("SUM", column)

    @staticmethod
    def avg(column):
        return Aggregate("AVG", column)

    @staticmethod
    def min(column):
        return Aggregate("MIN", column)

    @staticmethod
    def max(column):
        return Aggregate("MAX", column)

    @staticmethod
    def stddev(column):
        return Aggregate("STDDEV", column)

    @staticmethod
    def geomean(column):
        return Aggregate("GEOMEAN", column)

    @staticmethod
    def distinct(column):
        return Aggregate("DISTINCT", column)


class op:  # noqa: N801
    @staticmethod
    def and_(*predicates: Predicate) -> Predicate:
        return CombinedPredicate("and", predicates)

    @staticmethod
    def or_(*predicates: Predicate) -> Predicate:
        return CombinedPredicate("or", predicates)

    @staticmethod
    def not_(predicate: Predicate) -> Predicate:
        return predicate.negate()


def bind(index: int) -> Binder:
    return Binder(index)
