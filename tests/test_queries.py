"""Every registered query of the engine against its SQL."""

import duckdb
import pandas as pd
import pytest

from relspark.queries import ORACLE, QUERIES, TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(df):
    def plain(v):
        return None if v is None or (not hasattr(v, "__len__") and pd.isna(v)) else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(pd.Timestamp(v)) if hasattr(v, "isoformat") else v

    return sorted((tuple(map(plain, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLE[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
