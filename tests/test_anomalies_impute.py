"""Flags on planted readings and filled cells on a panel with known values."""

from __future__ import annotations

import datetime as dt
import math
import random
from statistics import NormalDist

import numpy as np
from pyspark.sql import functions as F

from panelforge.operators import anomalies
from panelforge.operators.anomalies import flag_readings, forward_backward, run_evidence
from panelforge.operators.impute import filled_cells, impute_chained

READINGS = "tbl int, id long, series long, source string, period int, v double, min_run int"


def test_planted_readings_are_flagged(spark):
    rng = np.random.default_rng(0)
    rows, bad, i = [], {}, 0
    for s in range(6):
        sd = 0.01 * (s + 1)
        v = rng.normal(0, sd, 300)
        v[50] = 15 * sd
        v[100:106] = 0.0123 * (s + 1)
        v[150:154] = 0.0321  # too short a run
        v[200:210] = 0.0  # zero runs are no case
        v[250] = -3.0
        v[270] = 6 * sd
        for t, x in enumerate(v):
            rows.append((0, i, s, f"src{s}", t, float(x), 5))
            if t == 50:
                bad[i] = "spike"
            elif 100 <= t < 106:
                bad[i] = "stuck"
            elif t == 250:
                bad[i] = "out_of_range"
            i += 1
    rows += [(0, i, 0, "src0", 50, 15 * 0.01, 5), (0, i + 1, None, None, 3, -2.0, 5), (0, i + 2, 0, "src0", None, -7.0, 5), (0, i + 3, 0, "src0", 3, float("nan"), 5), (0, i + 4, 0, "src0", 3, None, 5), (0, i + 5, None, "src0", 3, 0.1, 5)]
    got = {r["id"]: r["flag"] for r in flag_readings(spark.createDataFrame(rows, READINGS)).collect()}
    bad |= {i + 1: "out_of_range", i + 2: "out_of_range"}
    if rows[50][5] == rows[i][5]:
        bad[i] = "spike"
    assert got == bad


def test_no_readings(spark):
    empty = spark.createDataFrame([], READINGS)
    assert flag_readings(empty).count() == 0
    assert flag_readings(spark.createDataFrame([(0, 1, 1, "a", 1, 0.5, 5)], READINGS)).count() == 0


def test_run_evidence_counts_periods_not_rows():
    series = np.array([1, 1, 1, 1, 1, 2])
    period = np.array([1, 1, 2, 2, 3, 4])
    value = np.array([0.5, 0.6, 0.5, 0.7, 0.5, 0.5])
    same, length = run_evidence(series, period, value)
    assert length.tolist() == [3, 1, 3, 1, 3, 1]
    assert same.tolist() == [1, 0, 2, 0, 1, 0]


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(1)
    b = rng.random((4, 1, 4))
    post = forward_backward(b, np.array([4]))[:, 0]
    total = np.zeros((4, 4))
    for path in np.ndindex(4, 4, 4, 4):
        p = anomalies.START[path[0]] * b[0, 0, path[0]]
        for t in range(1, 4):
            p *= anomalies.TRANSITION[path[t - 1], path[t]] * b[t, 0, path[t]]
        for t in range(4):
            total[t, path[t]] += p
    assert np.allclose(post, total / total.sum(1, keepdims=True))
    padded = forward_backward(np.concatenate([b, rng.random((2, 1, 4))]), np.array([4]))[:4, 0]
    assert np.allclose(padded, post)


def test_long_series_run_in_small_batches(spark, monkeypatch):
    monkeypatch.setattr(anomalies, "BATCH_ROWS", 50)
    rng = random.Random(2)
    rows = [(0, s * 1000 + t, s, str(s), t, rng.gauss(0, 0.01) if t != 70 else 0.5, 5) for s in range(3) for t in range(120)]
    assert {r["id"] for r in flag_readings(spark.createDataFrame(rows, READINGS)).collect()} == {70, 1070, 2070}


def test_every_series_learns_its_own_normal_behaviour(spark):
    """A spike among few readings doesn't widen their scale; large moves up to eight deviations stay; each series is judged by itself, parts of a source by the source."""
    rng = np.random.default_rng(7)
    rows, bad = [], set()
    for s in range(30):
        sd = 0.01 * 2 ** (s % 4)
        v = rng.permutation([NormalDist().inv_cdf((i + 0.5) / 29) for i in range(29)])
        v[4], v[9] = 7.0, 12.5
        for t, x in enumerate(v * sd):
            if t == 9:
                bad.add(len(rows))
            rows.append((1, len(rows), s, f"own{s}", t, max(float(x), -0.99), 4))
    wide = np.clip(rng.normal(0, 1, 400), -2.5, 2.5) * 0.2
    for s, x in enumerate([*wide, 0.9, 3.0]):
        if x == 3.0:
            bad.add(len(rows))
        rows.append((2, len(rows), 1000 + s, "shared", 5, max(float(x), -0.99), 0))
    got = {r["id"] for r in flag_readings(spark.createDataFrame(rows, READINGS)).collect()}
    assert got == bad


PANEL = "row_id long, e int, d date, a double, b double, cat string, x double, a_filled string"
BOUNDS = {"a": (-10.0, 10.0), "b": (-50.0, 50.0)}


def make_panel(n_entities=40, n_months=24, seed=0):
    rng = np.random.default_rng(seed)
    rows, hidden = [], {}
    for e in range(n_entities):
        level, cat = rng.normal(0, 1), str(e % 4)
        for m in range(n_months):
            i = len(rows)
            x = rng.normal()
            a = level + 0.5 * x + rng.normal(0, 0.1)
            b = 2 * a + rng.normal(0, 0.1) + 5 * (e % 4)
            vals = {"a": a, "b": b, "cat": cat}
            for f in vals:
                if rng.random() < 0.1:
                    hidden[i, f] = vals[f]
                    vals[f] = {"a": rng.choice([math.nan, math.inf, 99.0]), "b": None, "cat": rng.choice(["", " ", "NA"])}[f]
            rows.append((i, e, dt.date(2020 + m // 12, m % 12 + 1, 28), None if vals["a"] is None else float(vals["a"]), None if vals["b"] is None else float(vals["b"]), str(vals["cat"]), float(x), "clash"))
    return rows, hidden


def fill(df):
    return impute_chained(df, "row_id", "e", "d", BOUNDS, "cat", ("0", "1", "2", "3"), ("x",))


def test_filled_values_are_close_and_marked(spark):
    rows, hidden = make_panel()
    out = fill(spark.createDataFrame(rows, PANEL))
    assert {(r["row_id"], r["field"]) for r in filled_cells(out, "row_id", ["a", "b", "cat"]).collect()} == set(hidden)
    got = {r["row_id"]: r for r in out.collect()}
    assert len(got) == len(rows)
    for f, tol in (("a", 0.35), ("b", 0.6)):
        err = [got[i][f] - v for (i, g), v in hidden.items() if g == f]
        assert np.sqrt(np.mean(np.square(err))) < tol
        assert np.std(err) > 0.05  # a residual draw, not the bare prediction
    assert np.mean([got[i]["cat"] == v for (i, g), v in hidden.items() if g == "cat"]) == 1.0
    for r in rows:
        if (r[0], "a") not in hidden:
            assert got[r[0]]["a"] == r[3]


def test_fills_do_not_depend_on_partitioning(spark):
    rows, _ = make_panel(10, 12)
    df = spark.createDataFrame(rows, PANEL)
    one = {r["row_id"]: (round(r["a"], 8), round(r["b"], 8)) for r in fill(df.repartition(1)).collect()}
    two = {r["row_id"]: (round(r["a"], 8), round(r["b"], 8)) for r in fill(df.repartition(7)).collect()}
    assert one == two


def test_entity_without_code_is_classified(spark):
    rows, _ = make_panel(40, 24, 3)
    rows = [(r[0], r[1], r[2], r[3], r[4], "n/a" if r[1] == 3 else r[5], r[6], r[7]) for r in rows]
    codes = {r["cat"] for r in fill(spark.createDataFrame(rows, PANEL)).where("e = 3").collect()}
    assert len(codes) == 1 and codes <= {"0", "1", "2", "3"}


def test_impute_edges(spark):
    assert fill(spark.createDataFrame([], PANEL)).count() == 0
    void = spark.createDataFrame([(1, 1, dt.date(2020, 1, 1), None, None, None, None, None), (2, None, None, None, 3.0, None, None, None)], PANEL)
    got = {r["row_id"]: r for r in fill(void).collect()}
    assert got[1]["a"] is None and not got[1]["a_filled"] and got[1]["cat"] is None and not got[1]["cat_filled"]
    assert got[1]["b"] is not None and got[1]["b_filled"] and not got[2]["b_filled"]
    twice = spark.createDataFrame([(1, 1, dt.date(2020, 1, 1), 1.0, 2.0, "1", 0.0, "")] * 2, PANEL)
    assert fill(twice).count() == 2
    assert fill(twice.select(*[F.col(c) for c in twice.columns])).where("a_filled").count() == 0
