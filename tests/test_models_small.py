"""The rolling model operators on a small panel, the gates, the pipeline's options and the public names."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge import api, session
from panelforge.models import em, rolling
from panelforge.models.forest import grow
from panelforge.plans import gates, panel, pipeline
from panelforge.sources import writers

MONTHS = [dt.date(2020 + i // 12, i % 12 + 1, 28) for i in range(14)]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    data = []
    for m in MONTHS:
        for e in range(25):
            a, b = rng.uniform(-0.5, 0.5, 2)
            data.append((m, e, float(0.2 * a - 0.1 * b + rng.normal(0, 0.02)), float(a), float(b)))
    return spark.createDataFrame(data, "month date, e long, y double, a double, b double")


@pytest.fixture(scope="module")
def covariates(spark):
    rng = np.random.default_rng(2)
    return spark.createDataFrame([(m, float(rng.normal()), float(0.1 + 0.1 * (i % 2))) for i, m in enumerate(MONTHS)], "month date, z double, vol double")


CFG = em.EMConfig(max_iter=2, max_monthly_points=15, max_prediction_points=60, gp_iterations=10)


def r2(df):
    return df.agg((1 - F.sum(F.pow(F.col("actual") - F.col("prediction"), 2)) / F.sum(F.pow("actual", 2))).alias("r2")).first()["r2"]


def test_rolling_forecasts_explain_and_stop_where_told(rows, covariates):
    args = (rows, covariates.select("month", "z"), covariates.select("month", "vol"), "month", "e", "y", ["a", "b"], ["z"], "vol", "2020-10-01", CFG)
    forecasts, regimes = rolling.rolling_forecast(*args, "2020-12-31", 2)
    assert forecasts.count() == 3 * 25 and regimes.count() == 3 and r2(forecasts) > 0.5
    assert [r["month"] for r in regimes.orderBy("month").collect()] == MONTHS[9:12]


def test_baselines_explain(rows):
    got = rolling.rolling_baselines(rows, "month", "e", "y", ["a", "b"], "2021-01-01", gp_points=60, gp_iter=20, trees=20, depth=6)
    by = {r["model"]: r["n"] for r in got.groupBy("model").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert by == {"Fama-MacBeth": 50, "Single-Regime GP": 50, "Random Forest": 50}
    assert all(r2(got.where(F.col("model") == m)) > 0.4 for m in by)
    one = rolling.single_gp(rows.where("month < '2021-01-01'"), rows.where("month >= '2021-01-01'"), "month", "e", "y", ["a", "b"], most=80)
    assert one.count() == 50 and r2(one) > 0.5


def test_gates(spark):
    got = gates.gp_fit_recovery(spark, "").collect()
    assert np.median([abs(r["fitted"] / r["truth"] - 1) for r in got]) < 0.2 and len(got) == 50
    assert gates.hmm_recovery(spark, "").first()["path_accuracy"] > 0.9
    assert max(abs(r["fitted"] - r["truth"]) for r in gates.transition_recovery(spark, "").collect()) < 0.5


def test_drawn_rows_are_without_replacement_and_fixed():
    sizes = np.array([5, 0, 9, 1])
    got = em.draw_rows(sizes, np.array([3, 2, 9, 0]), 7)
    assert [len(g) for g in got] == [3, 0, 9, 0] and all(len(set(g.tolist())) == len(g) for g in got)
    assert all((a == b).all() for a, b in zip(got, em.draw_rows(sizes, np.array([3, 2, 9, 0]), 7)))
    many = np.concatenate(em.draw_rows(np.full(4000, 10), np.full(4000, 3), 1))
    assert np.abs(np.bincount(many, minlength=10) / 4000 - 0.3).max() < 0.05


def test_fit_from_disk_and_options(spark, tmp_path, rows, covariates):
    wide = rows.select("month", F.col("e").alias("PERMNO"), F.col("y").alias("ex_ret"), *[F.col("a" if i % 2 else "b").alias(f) for i, f in enumerate(panel.FEATURES)])
    wide.write.parquet(f"{tmp_path}/ranked.parquet")
    fitted, months = api.fit_em_from_disk(spark, str(tmp_path), covariates, ["z"], "vol", CFG)
    assert months == MONTHS and len(fitted.path) == len(MONTHS) and np.isfinite(fitted.full_log_likelihood)
    ns = pipeline.argparse.Namespace(max_iter=3, seed=None, kernel="matern52_ard", max_monthly_points=0, max_months_per_regime=7, n_regimes=None)
    cfg = pipeline.configuration(ns)
    assert (cfg.max_iter, cfg.kernel, cfg.max_monthly_points, cfg.max_months_per_regime, cfg.n_regimes) == (3, "matern52_ard", None, 7, 2)
    assert pipeline.month_end("2012-02") == "2012-02-29" and pipeline.month_end(None) is None


def test_tables_with_another_kernel(spark, tmp_path):
    rng = np.random.default_rng(3)
    months = [dt.date(2020, i + 1, 28) for i in range(12)]
    for name, size in (("main", 0.1), ("other", 0.2)):
        f = spark.createDataFrame([(m, e, float(rng.normal(0, size)), float(rng.normal(0, 0.1))) for m in months for e in range(20)], "month date, entity long, prediction double, actual double")
        f.withColumn("model", F.lit(pipeline.MODEL)).unionByName(f.withColumn("model", F.lit("Fama-MacBeth"))).write.parquet(f"{tmp_path}/{name}/predictions.parquet")
        spark.createDataFrame([(m, i % 2, [0.5, 0.5], [[1.0] * 10] * 2) for i, m in enumerate(months)], "month date, predicted_state int, next_probs array<double>, lengthscales array<array<double>>").write.parquet(f"{tmp_path}/{name}/regimes.parquet")
        spark.createDataFrame([(m, *map(float, rng.normal(0, 0.03, 5))) for m in months], "month date, " + ", ".join(f"{c} double" for c in api.FIVE)).write.parquet(f"{tmp_path}/{name}/factors.parquet")
    text = pipeline.make_tables(spark, f"{tmp_path}/main", f"{tmp_path}/other", "Other kernel", f"{tmp_path}/t", f"{tmp_path}/f", "2020-02-01")
    assert text.count("Other kernel") == 4 and (tmp_path / "f/kernels.csv").exists() and (tmp_path / "t/table_2.csv").exists()
    stress = spark.read.option("header", True).csv(f"{tmp_path}/f/stress.csv")
    assert stress.count() == 11


def test_public_names(spark, rows):
    index = spark.createDataFrame([(dt.date(2020 + i // 12, i % 12 + 1, 15), 0.01 * (1 + 3 * (i > 12)) * (-1) ** i) for i in range(24)], "caldt date, sprtrn double")
    ends = [r["month"] for r in api.volatility_proxy(index).orderBy("month").collect()]
    states, one_hot = api.initialize_from_volatility_proxy(index, ends)
    assert len(states) == 24 and set(states) == {0, 1} and (one_hot.sum(1) == 1).all()
    with pytest.raises(ValueError):
        api.initialize_from_volatility_proxy(index, [dt.date(1990, 1, 31)])
    f = rows.select("month", F.col("e").alias("entity"), (F.col("y") * 0.5).alias("prediction"), F.col("y").alias("actual"), (F.col("e") % 2).alias("state"))
    assert all(abs(r["r2"] - 0.75) < 1e-9 for r in api.regime_conditional_oos_r2(f).collect())
    p = api.decile_long_short_from_frame(f)
    assert p.count() == len(MONTHS)
    rng = np.random.default_rng(4)
    factors = spark.createDataFrame([(m, *map(float, rng.normal(0, 0.03, 5))) for m in MONTHS], "month date, " + ", ".join(f"{c} double" for c in api.FIVE))
    assert abs(api.ff5_alpha(factors.select("month", (0.01 + F.col("mkt")).alias("long_short")), factors) - 0.12) < 1e-9


def test_a_failed_write_keeps_the_old_table(spark, tmp_path):
    path = f"{tmp_path}/t.parquet"
    writers.write_parquet(spark.range(3), path)
    with pytest.raises(Exception):
        writers.write_parquet(spark.range(3).select(F.raise_error(F.lit("no"))), path)
    assert spark.read.parquet(path).count() == 3
    writers.write_parquet(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5 and sorted(x.name for x in tmp_path.iterdir() if not x.name.startswith(".")) == ["t.parquet"]


def test_no_local_checkpoint_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default):
                return default

    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(Session())


def test_trees_fit_their_rows_and_split_best():
    rng = np.random.default_rng(5)
    x = np.round(rng.uniform(-0.5, 0.5, (150, 3)), 2)
    y = np.sin(4 * x[:, 0]) + x[:, 1] ** 2 + rng.normal(0, 0.05, 150)
    stump = grow(x, y, None, 1)
    sse = min(((y[m] - y[m].mean()) ** 2).sum() + ((y[~m] - y[~m].mean()) ** 2).sum() for f in range(3) for c in np.unique(x[:, f])[:-1] for m in [x[:, f] <= c])
    assert abs(((y - stump.predict(x)) ** 2).sum() - sse) < 1e-9 and len(stump.value) == 3
    whole = grow(x, y, None, 60)
    groups = {tuple(r): y[(x == r).all(1)].mean() for r in x}
    assert np.allclose(whole.predict(x), [groups[tuple(r)] for r in x])
    assert grow(x[:1], y[:1], None, 5).predict(x).tolist() == [y[0]] * 150
    xt = rng.uniform(-0.5, 0.5, (300, 3))
    got = np.mean([grow(x, y, np.random.default_rng(t), 30).predict(xt) for t in range(40)], 0)
    want = np.sin(4 * xt[:, 0]) + xt[:, 1] ** 2
    assert 1 - ((got - want) ** 2).sum() / ((want - want.mean()) ** 2).sum() > 0.9
