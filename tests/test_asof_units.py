"""Known-at-the-time joins and unit conversion."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from panelforge.operators.asof import asof_backward, known_from, version_join
from panelforge.operators.units import conversion_table, convert, infer_scales, infer_units, is_missing_code, reading_table

D = dt.date


def test_version_join_matches_brute_force(spark):
    rng = random.Random(5)
    day = lambda: D(2020, 1, 1) + dt.timedelta(rng.randrange(40))
    versions = [(rng.choice([1, 2, None]), rng.choice([day(), None]), day(), float(i)) for i in range(60)]
    events = [(i, rng.choice([1, 2, 3, None]), rng.choice([day(), day(), None]), "e") for i in range(80)]
    v = spark.createDataFrame(versions, "entity int, known date, period date, a double").withColumn("rank", F.struct("period", "known"))
    e = spark.createDataFrame(events, "id long, k int, at date, known_a string")
    out = {r["id"]: (r["known_period"], r["known_a"]) for r in version_join(e, "k", "at", v, ["period", "a"]).collect()}
    assert len(out) == 80
    for i, k, at, _ in events:
        able = [(p, kn, a) for en, kn, p, a in versions if en == k and k is not None and kn is not None and at is not None and kn <= at]
        if not able:
            assert out[i] == (None, None)
        else:
            p, kn, _ = max(able)
            assert out[i] == (p, max(a for pp, kk, a in able if (pp, kk) == (p, kn)))


def test_version_join_empty(spark):
    v = spark.createDataFrame([], "entity int, known date, period date, a double").withColumn("rank", F.struct("period", "known"))
    e = spark.createDataFrame([(1, 1, D(2020, 1, 1))], "id long, k int, at date")
    assert version_join(e, "k", "at", v, ["a"]).first()["known_a"] is None
    assert version_join(e.limit(0), "k", "at", v, ["a"]).count() == 0


def test_known_from_saturates(spark):
    r = spark.createDataFrame([(None, D(2019, 8, 31)), (D(2020, 5, 5), D(2019, 8, 31))], "p date, e date").select(known_from(F.col("p"), F.col("e")).alias("k")).collect()
    assert [x["k"] for x in r] == [D(2020, 2, 29), D(2020, 5, 5)]


def test_asof_lag_of_fundamentals(spark):
    """Figures of two year ends known after six months: none, then 100 for twelve months, then 110."""
    months = [D(2020 + i // 12, i % 12 + 1, 28) for i in range(24)]
    left = spark.createDataFrame([(1, m) for m in months], "k int, d date")
    right = spark.createDataFrame([(1, D(2019, 12, 31), 100.0), (1, D(2020, 12, 31), 110.0)], "k int, e date, a double").withColumn("avail", F.add_months("e", 6))
    got = [r["a"] for r in asof_backward(left, right, "k", "d", "avail", ["a"]).orderBy("d").collect()]
    assert got == [None] * 6 + [100.0] * 12 + [110.0] * 6


def test_asof_inclusive_and_nulls(spark):
    left = spark.createDataFrame([(1, D(2020, 1, 2)), (1, None), (None, D(2020, 1, 2)), (2, D(2020, 1, 1))], "k int, d date")
    right = spark.createDataFrame([(1, D(2020, 1, 2), None, 5), (1, D(2020, 1, 1), 1.0, 4), (None, D(2020, 1, 1), 9.0, 9)], "k int, t date, a double, b int")
    got = {(r["k"], r["d"]): (r["a"], r["b"]) for r in asof_backward(left, right, "k", "d", "t", ["a", "b"]).collect()}
    assert got == {(1, D(2020, 1, 2)): (None, 5), (1, None): (None, None), (None, D(2020, 1, 2)): (None, None), (2, D(2020, 1, 1)): (None, None)}


def test_conversion_graph():
    t = conversion_table((("c", "k", 1.0, 273.15), ("f", "c", 5 / 9, -160 / 9)))
    a, b, hops = t["f", "k"]
    assert hops == 2 and abs(a * 212 + b - 373.15) < 1e-9
    a, b, _ = t["k", "f"]
    assert abs(a * 373.15 + b - 212) < 1e-9
    with pytest.raises(ValueError):
        conversion_table((("a", "b", 2.0, 0.0), ("b", "c", 2.0, 0.0), ("a", "c", 5.0, 0.0)))
    with pytest.raises(ValueError):
        conversion_table((("a", "b", 0.0, 0.0),))


def test_convert_keeps_rows(spark):
    df = spark.createDataFrame([(1, 5.0, "percent", "o"), (2, 5.0, "nonsense", "o"), (3, None, "bp", "o"), (4, 7.0, None, "o")], "id int, v double, u string, out string")
    got = {r["id"]: r["out"] for r in convert(df, "v", "u", "fraction", "out").collect()}
    assert got == {1: 0.05, 2: None, 3: None, 4: None}


def units(df):
    return infer_units(df, ["series", "at"], "src", [F.col("block")], {"v": F.col("typical"), "w": F.lit(0.01)}, ["id"])


def test_infer_units_from_values(spark):
    rng = random.Random(1)
    rows, truth = [], {}
    for t in range(80):
        f = rng.gauss(0, 0.03)
        for s in range(6):
            unit = ("fraction", "fraction", "percent", "percent", "bp", "fraction")[s]
            if s == 5:
                unit = "percent" if t < 40 else "bp"
            if rng.random() < 0.03:
                unit = rng.choice(["fraction", "percent", "bp"])
            k = {"fraction": 1, "percent": 100, "bp": 10_000}[unit]
            i = len(rows)
            rows.append(("m", t, f"s{s}", t // 20, i, f * k * (1 + rng.gauss(0, 0.003)), 0.03))
            truth[i] = unit
    rows += [("m", 1, None, 0, 10_000, 0.0, 0.03), ("m", 1, "s0", 0, 10_001, float("nan"), 0.03), ("m", 1, "s0", 0, 10_002, None, 0.03)]
    df = spark.createDataFrame(rows, "series string, at int, src string, block int, id long, v double, typical double").withColumn("w", F.lit(None).cast("double"))
    got = {r["id"]: r["unit"] for r in units(df).collect()}
    assert got == truth
    assert units(df.limit(0)).count() == 0


def test_missing_codes(spark):
    df = spark.createDataFrame([(-99.99,), (-999.0,), (-0.5,), (None,)], "v float")
    assert [r["m"] for r in df.select(is_missing_code(F.col("v")).alias("m")).collect()] == [True, True, False, False]


def test_clashing_names(spark):
    v = spark.createDataFrame([(1, D(2020, 1, 1), D(2019, 12, 31), 5.0)], "entity int, known date, period date, a double").withColumn("rank", F.struct("period", "known"))
    e = spark.createDataFrame([(1, 1, D(2020, 1, 2), 7, 8, 9, 10, 11)], "id long, entity int, at date, attrs int, number int, rank int, a int, known_a int")
    r = version_join(e, "entity", "at", v, ["a"]).first()
    assert (r["attrs"], r["number"], r["rank"], r["a"], r["known_a"]) == (7, 8, 9, 10, 5.0)
    left = spark.createDataFrame([(1, D(2020, 1, 2), 3.0, 4)], "k int, d date, a double, t int")
    right = spark.createDataFrame([(1, D(2020, 1, 1), 6.0)], "k int, t date, a double")
    assert tuple(asof_backward(left, right, "k", "d", "t", ["a"]).first()) == (1, D(2020, 1, 2), 4, 6.0)
    u = spark.createDataFrame([("m", 1, "s", 1, 1, 0.02, 0.03, "x", "y", -999.0)], "series string, at int, src string, block int, id long, v double, typical double, bin string, lf_0 string, w double")
    assert [tuple(r) for r in units(u).collect()] == [(1, "v", 0.02, "fraction")]


def test_a_text_tells_where_one_source_reports_alone(spark):
    """Sources agree on most dates and teach what their texts are worth; on the last dates one source without a habit reports a size that fits two units."""
    rng = random.Random(3)
    rows = []
    for t in range(60):
        f = rng.gauss(0, 0.03)
        for s, (text, k) in enumerate((("dec.", 1), (" PCT", 100), ("pct", 100), ("DEC.", 1))):
            rows.append(("m", t, f"s{s}", 0, len(rows), f * k * (1 + rng.gauss(0, 0.002)), 0.03, text))
    alone = {}
    for t, text, unit in ((100, "dec.", "fraction"), (101, "pct", "percent"), (102, None, None)):
        alone[len(rows)] = unit
        rows.append(("m", t, "new", t, len(rows), 0.15, 0.03, text))
    df = spark.createDataFrame(rows, "series string, at int, src string, block int, id long, v double, typical double, said string").withColumn("w", F.lit(None).cast("double"))
    got = {r["id"]: r["unit"] for r in infer_units(df, ["series", "at"], "src", [F.col("block")], {"v": F.col("typical"), "w": F.lit(0.01)}, ["id"], texts=(F.col("said"),)).collect()}
    assert all(got[i] == u for i, u in alone.items() if u)
    assert all(got[r[4]] == ("percent" if r[7].strip().lower() == "pct" else "fraction") for r in rows[:240])


def test_units_come_from_the_graph(spark):
    """Names and factors are compositions: without its edge a scale has no reading, with a longer way the same one."""
    named = ("fraction", "percent", "bp")
    full = {r["__node"]: (r["unit"], r["__a"], r["__b"]) for r in reading_table(spark, "fraction", named).collect()}
    assert full["x1"] == ("fraction", 1.0, 0.0) and full["x100"] == ("percent", 0.01, 0.0) and full["x10000"][0] == "bp" and abs(full["x10000"][1] - 1e-4) < 1e-18
    less = {r["__node"] for r in reading_table(spark, "fraction", named, (("bp", "percent", 0.01, 0.0), ("percent", "fraction", 0.01, 0.0), ("x1", "fraction", 1.0, 0.0))).collect()}
    assert less == {"bp", "percent", "fraction", "x1"}
    with pytest.raises(ValueError):
        reading_table(spark, "fraction", named, (("bp", "percent", 0.01, 0.0), ("percent", "fraction", 0.01, 0.0), ("bp", "fraction", 0.01, 0.0)))


def test_missing_values_have_no_scale_and_rows_stay(spark):
    rows = [("m", t, f"s{s}", 0, 10 * t + s, (0.01 + 0.001 * t) * (1, 100, 1)[s], 0.03) for t in range(20) for s in range(3)] + [("m", 3, "s0", 0, 900, -99.99, 0.03), ("m", None, "s0", 0, 901, 0.02, 0.03), ("m", 3, "s0", 0, 902, None, 0.03)]
    df = spark.createDataFrame(rows, "series string, at int, src string, block int, id long, v double, typical double")
    got = {r["id"]: r["scale_0"] for r in infer_scales(df, ["series", "at"], "src", [F.col("block")], {"v": F.col("typical")}, ["id"]).collect()}
    assert len(got) == len(rows) and (got[900], got[901], got[902]) == (None, None, None)
    assert all(got[10 * t + s] == ("x1", "x100", "x1")[s] for t in range(20) for s in range(3))
