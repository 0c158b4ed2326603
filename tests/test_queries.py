"""Every core query with SQL against DuckDB over the smallest tables; every other one runs and gives a stable schema."""

from __future__ import annotations

import math
from pathlib import Path

import pytest

from panelforge.plans import catalogue

DATA = Path("/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if v is None:
            return "null"
        if isinstance(v, float):
            return "nan" if math.isnan(v) else f"{v + 0.0:.8g}"
        return str(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_matches_sql(spark, con, name):
    df = catalogue.queries()[name](spark, str(DATA))
    got = df.collect()
    cur = con.execute(catalogue.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert canonical([tuple(r) for r in got], df.columns) == canonical(cur.fetchall(), columns)


#: 180 fits each; tests/test_models_small.py runs the same code on a small panel.
SLOW = {"rolling_baselines", "rolling_oos_predict", "rolling_oos_regimes", "random_forest_predict", "single_gp_predict"}


#: Months of 20 rows or more are only in the larger tables.
LARGER = {"gp_month_likelihood"}


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql()) - SLOW))
def test_runs(spark, name):
    df = catalogue.queries()[name](spark, str(DATA.parent / "sf0.01" if name in LARGER else DATA))
    assert df.columns and df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
