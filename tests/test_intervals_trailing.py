"""Merged intervals and trailing totals against brute force, and their edge cases."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from panelforge.operators.intervals import clip_intervals, expand_months, first_interval_join, membership_filter, merge_intervals, months_to_intervals
from panelforge.operators.trailing import daily_values, idle_spans, trailing_prefix

D = dt.date


def brute(rows, lo, hi):
    out = set()
    for k in {r[0] for r in rows if r[0] is not None}:
        days = set()
        for key, s, e in rows:
            if key == k and s is not None:
                s, e = max(s, lo), min(e or hi, hi)
                days |= {s + dt.timedelta(i) for i in range((e - s).days + 1)}
        run = []
        for x in sorted(days):
            if run and (x - run[-1][1]).days == 1:
                run[-1][1] = x
            else:
                run.append([x, x])
        out |= {(k, "period", a, b) for a, b in run}
        out |= {(k, "gap", a[1] + dt.timedelta(1), b[0] - dt.timedelta(1)) for a, b in zip(run, run[1:])}
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_merge_matches_brute_force(spark, seed):
    rng = random.Random(seed)
    lo, hi = D(2020, 1, 1), D(2020, 3, 31)
    day = lambda: D(2019, 12, 20) + dt.timedelta(rng.randrange(120))
    rows = [(rng.choice([1, 2, 3, None]), rng.choice([day(), day(), None]), rng.choice([None, day(), day(), day()])) for _ in range(60)]
    rows += rows[:10]
    df = spark.createDataFrame(rows, "k int, start date, ending date")
    got = {tuple(r) for r in merge_intervals(df, "k", "start", "ending", str(lo), str(hi), str(hi)).collect()}
    assert got == brute(rows, lo, hi)


def test_merge_extra_columns_far_dates_and_empty(spark):
    df = spark.createDataFrame([(1, D(1, 1, 1), D(9999, 12, 31), "x", 5), (1, D(2000, 2, 2), D(1999, 1, 1), "y", 6)], "k int, start date, ending date, entity string, w int")
    assert [tuple(r) for r in merge_intervals(df, "k", "start", "ending", "2000-01-01", "2000-12-31", "2000-12-31").collect()] == [(1, "period", D(2000, 1, 1), D(2000, 12, 31))]
    assert merge_intervals(df.limit(0), "k", "start", "ending").count() == 0
    one = spark.createDataFrame([(1, D(2000, 1, 1), None)], "k int, start date, ending date")
    assert merge_intervals(one, "k", "start", "ending").count() == 0


def test_membership_and_months(spark):
    p = spark.createDataFrame([(1, D(2000, 1, 31)), (1, D(2000, 3, 31)), (2, D(2000, 1, 31)), (None, D(2000, 1, 31))], "k int, d date")
    iv = spark.createDataFrame([(1, D(2000, 1, 1), D(2000, 1, 31)), (1, D(2000, 1, 15), D(2000, 2, 10))], "k int, s date, e date")
    assert [tuple(r) for r in membership_filter(p, iv, "k", "d", "k", "s", "e").collect()] == [(1, D(2000, 1, 31))]
    assert [tuple(r) for r in first_interval_join(p, iv, "k", "d", "k", "s", "e").collect()] == [(1, D(2000, 1, 31), D(2000, 1, 1), D(2000, 1, 31))]
    m = months_to_intervals(spark.createDataFrame([(1, D(2000, 1, 5)), (1, D(2000, 2, 9)), (1, D(2000, 4, 1)), (1, None)], "k int, d date"), "k", "d")
    assert {tuple(r) for r in m.collect()} == {(1, D(2000, 1, 1), D(2000, 2, 29)), (1, D(2000, 4, 1), D(2000, 4, 30))}
    c = clip_intervals(iv, "k", "s", "e", "2000-01-20", "2000-01-25")
    assert [tuple(r) for r in c.collect()] == [(1, D(2000, 1, 20), D(2000, 1, 25))]
    assert {r["month"] for r in expand_months(iv, "k", "s", "e").collect()} == {D(2000, 1, 1), D(2000, 2, 1)}


def test_trailing_matches_brute_force(spark):
    rng = random.Random(3)
    base = D(2020, 1, 1)
    rows = []
    for i in range(120):
        rows.append((i, rng.choice([7, 8, None]), rng.choice([base + dt.timedelta(rng.randrange(60)), None, base + dt.timedelta(rng.randrange(60))]), rng.choice([0.1, -0.2, float("nan"), None, -1.0, -5.0, float("inf"), 0.03]), dt.datetime(2021, 1, 1) + dt.timedelta(rng.randrange(5))))
    df = spark.createDataFrame(rows, "id long, k int, d date, v double, loaded timestamp")
    cal = [base + dt.timedelta(i) for i in range(0, 60, 2)]
    calendar = spark.createDataFrame([(x,) for x in [*cal, cal[0], None]], "day date")
    usable = {}
    for i, k, d, v, t in rows:
        if k is not None and d is not None and v is not None and v == v and v not in (float("inf"),) and v > -1:
            usable.setdefault(k, {}).setdefault(d, []).append((t, i, v))
    want = {}
    for k, days in usable.items():
        one = {d: max(x)[2] for d, x in days.items()}
        for c in cal:
            if min(one) <= c <= max(one):
                for s in (1, 7):
                    xs = [v for d, v in one.items() if c - dt.timedelta(s) < d <= c]
                    want[k, c, s] = (len(xs), sum(xs) if xs else None)
    t = trailing_prefix(daily_values(df, "k", "d", "v", -1.0, ["loaded", "id"]), calendar, (1, 7))
    got = {}
    for r in t.collect():
        for s in (1, 7):
            got[r["entity"], r["day"], s] = (r[f"n_{s}"], r[f"total_{s}"])
    assert got.keys() == want.keys()
    for key, (n, total) in want.items():
        assert got[key][0] == n
        assert (total is None) == (got[key][1] is None)
        assert total is None or abs(got[key][1] - total) < 1e-9
    idle = {tuple(r) for r in idle_spans(t, (1, 7)).collect()}
    assert idle == {k for k, (n, _) in want.items() if n == 0}


def test_trailing_empty(spark):
    df = spark.createDataFrame([], "k int, d date, v double")
    cal = spark.createDataFrame([(D(2020, 1, 1),)], "day date")
    assert trailing_prefix(daily_values(df, "k", "d", "v"), cal, (7,)).count() == 0
    one = spark.createDataFrame([(1, D(2020, 1, 1), 0.5)], "k int, d date, v double")
    assert trailing_prefix(daily_values(one, "k", "d", "v"), cal.where(F.lit(False)), (7,)).count() == 0


def test_trailing_far_off_days(spark):
    """Days far outside the calendar count where they lie in a span, but fill nothing."""
    days = [D(1800, 1, 1), D(2019, 12, 30), D(2020, 1, 3), D(9990, 1, 1)]
    df = spark.createDataFrame([(1, x, 1.0) for x in days], "k int, d date, v double")
    cal = spark.createDataFrame([(D(2020, 1, i),) for i in range(1, 11)], "day date")
    t = trailing_prefix(daily_values(df, "k", "d", "v"), cal, (1, 7))
    got = {r["day"].day: (r["n_1"], r["n_7"]) for r in t.collect()}
    assert got == {1: (0, 1), 2: (0, 1), 3: (1, 2), 4: (0, 2), 5: (0, 2), 6: (0, 1), 7: (0, 1), 8: (0, 1), 9: (0, 1), 10: (0, 0)}
