"""Statements as Spark SQL text that runs."""

from __future__ import annotations

from ..functions import Aggregate
from ..predicates import Binder, literal
from ..types import Order
from .aggregates import aggregate_sql
from .compile import output_name, text


def _value(c) -> str:
    if not isinstance(c, Aggregate):
        return text(c)
    return f"DISTINCT {text(c.base)}" if c.fn == "DISTINCT" else aggregate_sql(c, text)


def select_sql(ctx, given=None) -> str:
    given = ctx.binds if given is None else given
    columns = ctx.columns or [c for t, _, _ in ctx.items for c in t.columns]
    grouped = {k.normalized_name for k in ctx.group_by or []}
    aggregated = bool(grouped) or any(isinstance(c, Aggregate) for c in columns)

    def item(c):
        v = _value(c)
        if aggregated and not isinstance(c, Aggregate) and c.normalized_name not in grouped:
            v = f"first({v})"
        return f"{v} AS `{output_name(c)}`"

    out = "SELECT " + ", ".join(map(item, columns)) + " FROM"
    for i, (t, kind, p) in enumerate(ctx.items):
        name = f"`{t.name}`" + f" AS `{t.effective_name}`"
        if i and kind == "from":
            out += " CROSS JOIN"
        elif i:
            out += " LEFT OUTER JOIN" if kind == "left" else " INNER JOIN"
        out += f" {name}" + (f" ON {p.to_sql(text, given)}" if i and kind != "from" else "")
    if ctx.where is not None:
        out += f" WHERE {ctx.where.to_sql(text, given)}"
    if ctx.group_by:
        out += " GROUP BY " + ", ".join(map(text, ctx.group_by))
    if ctx.order_by:
        keys = []
        for c, o in ctx.order_by:
            one = text(c.base) if isinstance(c, Aggregate) and c.fn == "DISTINCT" else _value(c)
            if len(columns) == 1 and isinstance(columns[0], Aggregate) and columns[0].fn == "DISTINCT":
                one = f"`{output_name(columns[0])}`"
            elif aggregated and not isinstance(c, Aggregate) and c.normalized_name not in grouped:
                one = f"last({one})"
            keys.append(f"{one} {'ASC NULLS FIRST' if o is Order.ASC else 'DESC NULLS LAST'}")
        out += " ORDER BY " + ", ".join(keys)
    value = lambda x: x.value(given) if isinstance(x, Binder) and given is not None else x if not isinstance(x, Binder) else literal(x)
    out += "" if ctx.limit is None else f" LIMIT {value(ctx.limit)}"
    return out + ("" if not ctx.skip else f" OFFSET {value(ctx.skip)}")


def insert_sql(table, rows, replace: bool) -> str:
    if isinstance(rows, Binder):
        return f"INSERT INTO `{table.name}` VALUES {literal(rows)}"
    def row(r):
        if isinstance(r, Binder):
            return literal(r)
        full = table.create_row(r)
        return "(" + ", ".join(literal(full[c.name]) for c in table.columns) + ")"

    body = ", ".join(map(row, rows))
    return f"INSERT {'OR REPLACE ' * replace}INTO `{table.name}` ({', '.join(f'`{c.name}`' for c in table.columns)}) VALUES {body}"


def update_sql(table, sets, where, given=None) -> str:
    value = lambda v: literal(v.value(given)) if isinstance(v, Binder) and given is not None else literal(v)
    out = f"UPDATE `{table.name}` SET " + ", ".join(f"`{c.name}` = {value(v)}" for c, v in sets)
    return out if where is None else f"{out} WHERE {where.to_sql(text, given)}"


def delete_sql(table, where, given=None) -> str:
    out = f"DELETE FROM `{table.name}`"
    return out if where is None else f"{out} WHERE {where.to_sql(text, given)}"
