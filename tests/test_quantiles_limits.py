"""Exact quantiles against sorting, and plans that fold hot keys before the shuffle."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.operators import quantiles, sampling, windows
from panelforge.operators.quantiles import exact_quantiles


@pytest.mark.parametrize("fetch", [500_000, 300])
def test_quantiles_match_numpy(spark, monkeypatch, fetch):
    monkeypatch.setattr(quantiles, "FETCH_LIMIT", fetch)
    rng = np.random.default_rng(0)
    data = {"a": rng.normal(size=20_000), None: np.round(rng.exponential(size=5_000), 1), "c": np.full(3_000, 7.0), "d": np.array([4.0]), "e": np.array([1.0, 2.0])}
    rows = [(k, float(x)) for k, v in data.items() for x in v] + [("a", None), ("void", None)]
    got = {r["k"]: r["q"] for r in exact_quantiles(spark.createDataFrame(rows, "k string, x double"), ["k"], "x", (0.01, 0.5, 0.99)).collect()}
    assert got.pop("void") == [None] * 3 and got.keys() == data.keys()
    for k, v in data.items():
        assert np.allclose(got[k], np.quantile(v, [0.01, 0.5, 0.99]), atol=1e-12)
    assert exact_quantiles(spark.createDataFrame([], "k string, x double"), ["k"], "x", (0.5,)).count() == 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_picks_are_limited_before_the_shuffle(spark):
    """A third of all rows in one key: each map task sends a row (or n) of it."""
    df = spark.range(0, 30_000, 1, 6).select(F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 97).alias("k"), "id", F.lit("x").alias("other"))
    for picked, n in ((windows.last_row(df, ["k"], F.col("id").desc()), 1), (windows.top_per_group(df, "k", 5, F.col("id")), 5), (sampling.hash_sample(df, "k", "id", 20), 20)):
        text = plan(picked)
        assert "WindowGroupLimit" in text and "Partial" in text
        assert picked.where("k = 0").count() == n
