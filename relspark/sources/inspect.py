"""A look at stored databases, as JSON text."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from ..schema import ROW_ID
from .files import Files
from .store import Store
from .upgrade import tables_of


def inspect(spark: SparkSession, folder: str, database: str | None = None, table: str | None = None, limit: int = 100, skip: int = 0) -> str:
    """Databases below ``folder`` with versions; or one's tables with row counts; or some of a table's rows."""
    if database is None:
        found = {}
        for n in Files(spark, folder).names():
            s = Store(spark, f"{folder}/{n}")
            if s.number >= 0:
                found[n] = s.version
        return json.dumps(found)
    store = Store(spark, f"{folder}/{database}")
    kinds = tables_of(store)
    if table is None:
        return json.dumps({n: store.read(t, store.state(n)).count() for n, t in kinds.items()})
    rows = store.read(kinds[table], store.state(table)).orderBy(ROW_ID).drop(ROW_ID).offset(skip).limit(limit)
    return "[" + ",".join(rows.toJSON().collect()) + "]"
