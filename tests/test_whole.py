"""The whole job: every source, unit, day, membership and row."""

from __future__ import annotations

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from panelforge.models import em, gp, hmm, rolling
from panelforge.plans import evaluation, modeling, panel, pipeline, prepare, relational

FIELDS = ("mkt_rf", "smb", "hml", "rmw", "cma", "mom", "rf")


def factor_rows(days, sources, scale):
    """Reports of one true series by every source; ``scale``: a source's factor on its numbers."""
    rows = []
    for i, day in enumerate(days):
        size = 1 + (i % 3) / 10
        for s in sources:
            v = [x * size * scale.get(s, 1.0) for x in (0.009, 0.005, -0.005, 0.004, -0.004, 0.007, 0.00015)]
            rows.append([len(rows), day, *v, s, "", "", dt.datetime(2020, 1, 1)])
    return rows


def write_factors(spark, folder, name, rows):
    schema = "row_id long, date date, " + ", ".join(f"{f} double" for f in FIELDS) + ", src string, unit string, note string, loaded_at timestamp_ntz"
    spark.createDataFrame([tuple(r) for r in rows], schema).write.parquet(f"{folder}/{name}.parquet")


def test_a_day_needs_no_complete_row_of_one_source(spark, tmp_path):
    days = [dt.date(2020, 1, 1) + dt.timedelta(i) for i in range(20)]
    rows = factor_rows(days, ["factor_library", "b", "c"], {"b": 100.0, "c": 10_000.0})
    of = {(r[1], r[9]): r for r in rows}
    of[days[3], "factor_library"][4] = None  # hml
    of[days[4], "factor_library"][2:9] = [100 * x for x in of[days[4], "factor_library"][2:9]]
    of[days[5], "factor_library"][3] = -99.99
    for s in ("factor_library", "b", "c"):
        of[days[6], s][8] = 0.0  # rf
    write_factors(spark, tmp_path, "ff_factors_daily", rows)
    write_factors(spark, tmp_path, "ff_factors", rows[:0])
    got = {r["date"]: r for r in relational.daily_factors(spark, str(tmp_path)).collect()}
    assert sorted(got) == days and got[days[6]]["rf"] == 0.0
    assert all(abs(r["mkt"] / (0.009 * (1 + (i % 3) / 10)) - 1) < 1e-9 for i, r in enumerate(got[d] for d in days))
    true = 1.0
    for i in range(20):
        true *= 1 + (0.0 if i == 6 else 0.00015 * (1 + (i % 3) / 10))
    assert abs(relational.rf_months(spark, str(tmp_path)).first()["rf"] - (true - 1)) < 1e-9


def test_a_day_without_a_figure_makes_its_month_null(spark, tmp_path):
    days = [dt.date(2020, 1, 1) + dt.timedelta(i) for i in range(40)]
    rows = factor_rows(days, ["factor_library", "b"], {})
    for r in rows:
        if r[1] == days[2]:
            r[8] = None
    write_factors(spark, tmp_path, "ff_factors_daily", rows)
    write_factors(spark, tmp_path, "ff_factors", rows[:0])
    got = {r["month"].month: r["rf"] for r in relational.rf_months(spark, str(tmp_path)).collect()}
    assert got[1] is None and got[2] > 0
    assert prepare.factor_series(spark, str(tmp_path), "ff_factors_daily", ["rf"]).count() == 40


def test_the_last_likelihood_is_of_whole_months(spark):
    rng, n, t = np.random.default_rng(4), 30, 8
    days = [dt.date(2020, i + 1, 28) for i in range(t)]
    x, y = rng.normal(size=(t, n, 2)), rng.normal(0, 0.1, (t, n))
    rows = spark.createDataFrame([(days[i], e, float(y[i, e]), *map(float, x[i, e])) for i in range(t) for e in range(n)], "month date, e long, y double, a double, b double")
    z = rng.normal(size=t)
    zs = spark.createDataFrame([(d, float(v), float(0.1 + 0.1 * (i % 2))) for i, (d, v) in enumerate(zip(days, z))], "month date, z double, vol double")
    cfg = em.EMConfig(max_iter=2, max_monthly_points=8, max_prediction_points=12, gp_iterations=5)
    forecasts, regimes = rolling.rolling_forecast(rows, zs.select("month", "z"), zs.select("month", "vol"), "month", "e", "y", ["a", "b"], ["z"], "vol", "2020-06-01", cfg)
    assert forecasts.count() == 3 * n
    got = regimes.orderBy("month").collect()
    assert [r["month"] for r in got] == days[5:]
    for i, r in enumerate(got, 5):
        params = [gp.GPParams(np.array(s), a, b) for s, a, b in zip(r["lengthscales"], r["signal_var"], r["noise_var"])]
        log_p = hmm.log_transitions(np.array(r["transition_w"]).reshape(2, 2, 1), np.array(r["transition_b"]).reshape(2, 2), z[:i, None])
        log_b, log_pi = em.emissions(x[:i], y[:i], params, "se_ard"), np.log(np.clip(r["pi"], 1e-12, None))
        assert abs(r["full_log_likelihood"] - hmm.posteriors(log_pi, log_p, log_b)[2]) < 1e-6
        assert r["viterbi_state"] == hmm.viterbi(log_pi, log_p, log_b)[-1]


def test_model_queries_forecast_from_the_published_month_on():
    assert modeling.OOS_FIRST == "2010-01-01" and not hasattr(modeling, "SMALL")
    sizes = np.array([1000, 10])
    few = em.training_rows([np.zeros((50, 1))] * 2, [np.zeros(50)] * 2, np.ones(2), 50, 0, sizes)[1]
    assert len(few) == 50


def test_an_open_membership_lasts_to_the_panel_end(spark):
    held = spark.createDataFrame([(1, dt.date(1990, 1, 1), None), (2, dt.date(2010, 1, 1), dt.date(2010, 12, 31)), (None, dt.date(2010, 1, 1), None)], "permno int, start date, ending date")
    rows = spark.createDataFrame([(1, dt.date(2024, 12, 31)), (2, dt.date(2010, 6, 30)), (2, dt.date(2011, 1, 31))], "PERMNO int, MthCalDt date")
    assert sorted(tuple(r) for r in panel.universe(rows, panel.members(held)).collect()) == [(1, dt.date(2024, 12, 31)), (2, dt.date(2010, 6, 30))]


def test_the_monthly_rate_is_a_fraction_whatever_the_units(spark, tmp_path):
    days = [dt.date(2020, i + 1, 28) for i in range(12)]
    rows = factor_rows(days, ["a", "b", "c"], {"b": 100.0, "c": 10_000.0})
    for r in rows:
        r[2:9] = [4 * x for x in r[2:8]] + [20 * r[8]]  # monthly sizes
    rows[0][8] = -99.99
    write_factors(spark, tmp_path, "ff_factors", rows)
    got = [r["rf"] for r in prepare.monthly_rf(spark, str(tmp_path)).orderBy("month").collect()]
    assert all(abs(x / (0.003 * (1 + (i % 3) / 10)) - 1) < 1e-9 for i, x in enumerate(got)) and len(got) == 12


def test_build_takes_the_rate_and_open_members(spark, tmp_path):
    source = "/root/testdata/sf0.001"
    pipeline.build_panel(spark, source, str(tmp_path), least=1)
    rows = spark.read.parquet(f"{tmp_path}/ranked.parquet")
    size = rows.select(F.median(F.col("ret") - F.col("ex_ret")).alias("m"), F.count_if(F.col("MthCalDt") >= "2024-01-01").alias("n")).first()
    assert 0 < size["m"] < 0.01 and size["n"] > 0


def test_month_likelihood_reads_every_row(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x, y = rng.uniform(-0.5, 0.5, (250, 4)), rng.normal(0, 0.1, 250)
    rows = spark.createDataFrame([(dt.date(2020, 1, 31), e, float(y[e]), *map(float, x[e])) for e in range(250)], "month date, PERMNO int, target double, " + ", ".join(f"{f} double" for f in modeling.FEATURES))
    monkeypatch.setattr(modeling, "whole_rows", lambda s, d: rows)
    got = modeling.gp_month_likelihood(spark, "").first()
    p = gp.GPParams(np.full(4, 0.5), 0.01, 0.01)
    assert got["n"] == 250
    assert abs(got["se_ard"] - gp.log_likelihood(x, y, p)) < 1e-3 and abs(got["matern52_ard"] - gp.log_likelihood(x, y, p, "matern52_ard")) < 1e-3


def test_kernels_of_whole_vectors(spark, tmp_path):
    x = np.random.default_rng(9).normal(0, 0.1, (6, 64))
    spark.createDataFrame([(i, i % 2, [float(v) for v in x[i]]) for i in range(6)], "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    u = np.array([[((x[i] - x[k::2].mean(0)) ** 2).sum() / 2.0 for k in (0, 1)] for i in range(6)])
    want = {"se_ard_kernel": 1.5 * np.exp(-0.5 * u), "matern52_kernel": 1.5 * (1 + np.sqrt(5 * u) + 5 / 3 * u) * np.exp(-np.sqrt(5 * u))}
    for name, k in want.items():
        got = evaluation.QUERIES[name](spark, str(tmp_path)).collect()
        assert len(got) == 12 and all(abs(r["k"] - k[r["vec_id"], r["label"]]) < 2e-6 for r in got)


def test_a_large_return_stays_unless_it_is_flagged(spark, monkeypatch):
    rows = [(e, dt.date(2020, 1, 31), 1.5 if e == 3 else 9.0 if e == 4 else 0.01 * e, *[0.1 * e] * 4) for e in range(25)]
    p = spark.createDataFrame(rows, "PERMNO int, month date, ret double, " + ", ".join(f"{f} double" for f in modeling.FEATURES))
    monkeypatch.setattr(modeling, "_fund", lambda s, d: p)
    monkeypatch.setattr(modeling.panel, "with_ratios", lambda x: x)
    monkeypatch.setattr(modeling.panel, "with_momentum", lambda x: x)
    monkeypatch.setattr(modeling, "rf_months", lambda s, d: spark.createDataFrame([(dt.date(2020, 1, 31), 0.0)], "month date, rf double"))
    bad = p.where("PERMNO = 4").select("PERMNO", "month", "ret")
    assert {r["PERMNO"] for r in modeling.model_rows(spark, "", bad=bad).collect()} == {*range(25)} - {4}
    assert {r["PERMNO"] for r in modeling.model_rows(spark, "").collect()} == {*range(25)}


def test_tables_of_all_models_and_figures(spark, tmp_path, monkeypatch):
    rng, out = np.random.default_rng(3), str(tmp_path)
    months = [dt.date(2020, i + 1, 28) for i in range(12)]
    one = spark.createDataFrame([(m, e, float(rng.normal()), 1.0, float(rng.normal(0, 0.1))) for m in months for e in range(20)], "month date, entity long, prediction double, prediction_var double, actual double")
    base = one.select("month", "entity", F.lit("Fama-MacBeth").alias("model"), (-F.col("prediction")).alias("prediction"), "actual")
    regimes = spark.createDataFrame([(m, i % 2, [0.5, 0.5], [[1.0] * 10] * 2) for i, m in enumerate(months)], "month date, predicted_state int, next_probs array<double>, lengthscales array<array<double>>")
    monkeypatch.setattr(pipeline.rolling, "rolling_forecast", lambda *a: (one, regimes))
    monkeypatch.setattr(pipeline.rolling, "rolling_baselines", lambda *a: base)
    factors = spark.createDataFrame([(m, *map(float, rng.normal(0, 0.03, 5))) for m in months], "month date, " + ", ".join(f"{c} double" for c in evaluation.FF5))
    monkeypatch.setattr(pipeline.evaluation, "monthly_factors", lambda *a: factors)
    one.write.parquet(f"{out}/ranked.parquet")
    z = spark.createDataFrame([(m, 0.1, 0.2) for m in months], "month date, z double, vol double")
    pipeline.run(spark, out, out, "2020-01-01", em.EMConfig(), z, ["z"], "vol")
    text = pipeline.make_tables(spark, out)
    assert "Fama-MacBeth" in text and "Regime GP" in text
    for name in ("table_1", "table_2", "alpha_bars", "lengthscales", "stress"):
        assert (tmp_path / f"{name}.csv").exists(), name
