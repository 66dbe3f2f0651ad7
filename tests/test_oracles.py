"""Every registered query of the library's own operators against its DuckDB twin on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from tessera.plans import business, profiles, reviews, sales, texts, trips

SF = "/root/testdata/sf0.001"
CATALOGS = (business.C, sales.C, profiles.C, texts.C, reviews.C, trips.C)
QUERIES = {n: q for c in CATALOGS for n, q in c.queries.items()}
SQL = {n: q for c in CATALOGS for n, q in c.sql.items()}
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(v):
    v = v.item() if hasattr(v, "item") else v
    if v is None or v is pd.NA or v != v:
        return None
    return round(float(v), 3) if isinstance(v, float) else list(v) if hasattr(v, "tolist") else v


def rows(frame):
    names = sorted(frame.columns)
    return names, sorted(repr([plain(v) for v in r]) for r in frame[names].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    got, want = rows(QUERIES[name](spark, SF).toPandas()), rows(duck.execute(SQL[name]).df())
    assert got[0] == want[0]
    assert [x.replace(".0,", ",").replace(".0]", "]") for x in got[1]] == [x.replace(".0,", ",").replace(".0]", "]") for x in want[1]]


@pytest.mark.parametrize("name", sorted(n for n in trips.C.sql))
def test_rules_fire(duck, name):
    assert len(duck.execute(SQL[name]).df()) > 0


def test_every_query_has_rows_or_sql():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_without_sql(spark, name):
    assert QUERIES[name](spark, SF).count() >= 1
