"""Every query that has SQL equals it on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from lectern.plans import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, (list, tuple)) or hasattr(v, "tolist") and getattr(v, "ndim", 0):
        return "[" + ",".join(map(norm, v)) + "]"
    if v is None or v is pd.NaT or v is pd.NA or v != v:
        return "null"
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return str(bool(v))
    if hasattr(v, "__float__") and not isinstance(v, str):
        return f"{float(v):.9g}"
    return str(v)


def rows(df: pd.DataFrame) -> list[str]:
    return sorted("|".join(map(norm, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{DIR}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, db, name):
    got, want = catalog.queries()[name](spark, DIR).toPandas(), db.execute(catalog.oracle_sql()[name]).df()
    assert set(got.columns) == set(want.columns)
    assert rows(got) == rows(want)


def test_all_have_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())
