"""Every query with SQL of its own gives the same rows in DuckDB, on the smallest tables."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from pricetide.plans.catalogue import ORACLES, QUERIES

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents pages".split()

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


def value(x):
    if x is None or x is pd.NA or x != x:
        return None
    return round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) or type(x).__module__ == "numpy" and x.dtype.kind in "iuf" else str(x)


def rows(df):
    return sorted((tuple(map(value, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", ORACLES)
def test_same_rows(name, spark, duck):
    ours, theirs = QUERIES[name](spark, str(DATA)).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", [q for q in QUERIES if q not in ORACLES])
def test_runs(name, spark):
    assert QUERIES[name](spark, str(DATA)).count() > 0


def test_sequential_sees_the_whole_catalogue(spark):
    """Identifiers of every product, and brands that no product has."""
    got = {r.method: r for r in QUERIES["m11_sequential"](spark, str(DATA)).collect()}
    assert got["ean"].linked == QUERIES["m2_by_ean"](spark, str(DATA)).count() and got["new_product"].made > 0


@pytest.mark.parametrize(("name", "table"), [("t2_brand_key_all", "documents"), ("t1_fold_exact_all", "documents"), ("n9_offer_size_all", "part")])
def test_whole_tables(name, table, spark):
    assert QUERIES[name](spark, str(DATA)).count() == spark.read.parquet(f"{DATA}/{table}.parquet").count()
