"""Surviving records and the source model; mixing to target shares."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.llm.mixing import mix_copies, mix_shares
from panelforge.llm.survivors import fit_two_sided, survivors

TRUST = ("P", "C", "J", "N", None)
SCHEMA = "id long, k int, d date, key int, end date, link string, at timestamp, name string, x double, n_records string"


def run(df, **kw):
    return survivors(df, (F.col("k"), F.date_format("d", "yyyy-MM")), "key", "end", "d", "link", TRUST, "at", ("x",), "name", **kw)


def test_survivors_match_brute_force(spark):
    rng = random.Random(0)
    day = lambda a, n: D(a) + dt.timedelta(rng.randrange(n))
    D = lambda s: dt.date.fromisoformat(s)
    rows = []
    for i in range(400):
        rows.append((i, rng.choice([1, 2, 3, None]), rng.choice([day("2020-01-01", 90), None, day("2020-01-01", 90)]), rng.choice([None, 10, 11, 12]), rng.choice([None, day("2019-11-01", 120)]), rng.choice([*TRUST, "X"]), dt.datetime(2021, 1, 1) + dt.timedelta(minutes=i), rng.choice(["a", " A", "b", None]), rng.choice([None, 1.0, 2.0]), "clash"))
    got = {(r["g1"], r["g2"]): r for r in run(spark.createDataFrame(rows, SCHEMA)).collect()}
    groups = {}
    for r in rows:
        if r[1] is not None and r[2] is not None:
            groups.setdefault((r[1], r[2].strftime("%Y-%m")), []).append(r)
    groups = {g: x for g, x in groups.items() if len(x) > 1}
    assert got.keys() == groups.keys()
    rank = {s: i for i, s in enumerate(TRUST)}
    for g, x in groups.items():
        known = [r for r in x if r[3] is not None]
        key = min(known, key=lambda r: (rank.get(r[5], 5), -r[6].timestamp(), -r[3]))[3] if known else None
        ends = [r[4] for r in x if r[3] == key and key is not None and r[4] is not None and r[4] <= r[2]]
        filled = [r for r in x if r[8] is not None]
        assert (got[g]["key"], got[g]["end"], got[g]["n_records"]) == (key, max(ends, default=None), len(x))
        assert got[g]["x"] == (min(filled, key=lambda r: (rank.get(r[5], 5), -r[6].timestamp()))[8] if filled else None)
        assert (got[g]["key_p"] is None) == (key is None)


def test_survivors_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert run(empty).count() == 0
    alone = spark.createDataFrame([(1, 1, dt.date(2020, 1, 1), 5, None, "P", None, None, None, None)], SCHEMA)
    assert run(alone).count() == 0
    assert run(alone, least_records=1).first()["key"] == 5
    twice = run(alone.union(alone)).first()
    assert (twice["key"], twice["end"], twice["n_records"]) == (5, None, 2)


def test_model_finds_source_quality():
    """Two good sources and a careless one; several values of a group may be true."""
    rng = np.random.default_rng(0)
    sens, spec = np.array([0.95, 0.9, 0.5]), np.array([0.98, 0.95, 0.6])
    counts = {}
    for _ in range(20_000):
        true = rng.random() < 0.5
        c = rng.random(3) < np.where(true, sens, 1 - spec)
        if c.any():
            counts[int(c @ [1, 2, 4]), 7] = counts.get((int(c @ [1, 2, 4]), 7), 0) + 1
    m = fit_two_sided(counts, 3, 200)
    assert m.specificity.argmin() == 2 and m.sensitivity.argmin() == 2
    assert m.posterior[3, 7] > 0.95 and m.posterior[4, 7] < 0.2
    assert fit_two_sided({}, 3).posterior == {}


TARGETS = [("a", 0.5, 2), ("b", 0.3, 5), ("c", 0.2, 1), ("gone", 0.1, 3), (None, 0.4, 1)]


def corpus(spark, n=3000, seed=0):
    rng = random.Random(seed)
    rows = [(i, rng.choices(["a", "b", "c", "d", None], [60, 5, 30, 4, 1])[0], rng.choice([None, 0, 5, 50, 500, rng.randrange(1, 3000)]), "clash") for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, source string, n long, rate string")


def test_mix_reaches_targets_within_caps(spark):
    rows, df = corpus(spark)
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    copies = mix_copies(df, "id", "source", "n", targets)
    got = {r["id"]: r["copies"] for r in copies.collect()}
    assert len(got) == len(rows)
    cap = {"a": 2, "b": 5, "c": 1}
    size = {s: sum(r[2] or 0 for r in rows if r[1] == s) for s in cap}
    reach = min(cap[s] * size[s] / share for s, share in (("a", 0.5), ("b", 0.3), ("c", 0.2)))
    for i, s, n, _ in rows:
        if s in cap and n:
            rate = reach * {"a": 0.5, "b": 0.3, "c": 0.2}[s] / size[s]
            assert got[i] <= cap[s] and abs(got[i] - rate) < 1
        else:
            assert got[i] == 0
    shares = {r["source"]: r for r in mix_shares(copies.withColumnRenamed("n", "n_tokens"), targets).collect()}
    for s, share in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        assert abs(shares[s]["actual_share"] - share) < 0.03
    assert shares["gone"]["used"] == 0


def test_mix_is_systematic(spark):
    """With one rate for all, uses over any stretch of the order differ from the expectation by less than one: totals by source do."""
    rows, df = corpus(spark, 2000, 3)
    targets = spark.createDataFrame(TARGETS[:3], "source string, target_share double, max_repeats int")
    a = {r["id"]: r["copies"] for r in mix_copies(df.repartition(5), "id", "source", "n", targets).collect()}
    b = {r["id"]: r["copies"] for r in mix_copies(df.repartition(2), "id", "source", "n", targets).collect()}
    assert a == b
    cap = {"a": 2, "b": 5, "c": 1}
    size = {s: sum(r[2] or 0 for r in rows if r[1] == s) for s in cap}
    reach = min(cap[s] * size[s] / share for s, share in (("a", 0.5), ("b", 0.3), ("c", 0.2)))
    for s, share in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        n = sum(1 for r in rows if r[1] == s and r[2])
        assert abs(sum(a[r[0]] for r in rows if r[1] == s) - n * reach * share / size[s]) < 1


def test_mix_edges(spark):
    _, df = corpus(spark, 50)
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    assert mix_copies(df.limit(0), "id", "source", "n", targets).count() == 0
    none = mix_copies(df, "id", "source", "n", targets.limit(0))
    assert none.count() == 50 and none.where("copies > 0").count() == 0
    big = mix_copies(df, "id", "source", "n", targets, total=1e12)
    assert big.where("source = 'a' AND n > 0").select("copies").distinct().first()[0] == 2
    twice = df.union(df)
    assert mix_copies(twice, "id", "source", "n", targets).count() == 100


@pytest.mark.parametrize("stretch", [1, 7])
def test_stretches_do_not_change_totals(spark, monkeypatch, stretch):
    from panelforge.llm import mixing

    monkeypatch.setattr(mixing, "STRETCH", stretch * 50)
    rows, df = corpus(spark, 1000, 5)
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    got = mix_copies(df, "id", "source", "n", targets, total=sum(r[2] or 0 for r in rows if r[1] == "a") / 4)
    n = sum(1 for r in rows if r[1] == "a" and r[2])
    assert abs(got.agg(F.sum("copies")).first()[0] - n / 4) < 1


def test_order_of_trust_shows_in_the_posterior():
    """However the data lie, a claim of an earlier source outweighs all later ones together; without the order they win."""
    counts = {(1, 7): 50, (6, 7): 50, (1, 3): 20, (2, 3): 20, (7, 7): 400}
    free, bound = fit_two_sided(counts, 3), fit_two_sided(counts, 3, ordered=True)
    assert bound.log_odds[1, 7] > bound.log_odds[6, 7] and bound.log_odds[1, 3] > bound.log_odds[2, 3]
    assert free.log_odds[6, 7] > free.log_odds[1, 7]


def test_judged_fields_go_by_quality_and_multi_keeps_every_true_value(spark):
    """The first source is careless with x, two others agree; both names of a group are told by good sources, a third name by a bad one."""
    at = lambda i: dt.datetime(2021, 1, 1) + dt.timedelta(minutes=i)
    rows, rng = [], random.Random(4)
    for g in range(300):
        day = dt.date(2000 + g // 12, g % 12 + 1, 5)
        for link in ("P", "C", "J"):
            x = float(g) if link != "P" or rng.random() < 0.3 else float(g) + 0.5
            for name in ("one", "two"):
                rows.append((len(rows), 1, day, 7, None, link, at(len(rows)), name, x, ""))
        if g % 10 == 0:
            rows.append((len(rows), 1, day, 7, None, "N", at(len(rows)), "wrong", float(g), ""))
    df = spark.createDataFrame(rows, SCHEMA)
    got = survivors(df, (F.col("k"), F.date_format("d", "yyyy-MM")), "key", "end", "d", "link", TRUST, "at", multi="name", judged=("x",)).collect()
    assert len(got) == 300
    for r in got:
        y, m = map(int, r["g2"].split("-"))
        assert r["x"] == float((y - 2000) * 12 + m - 1) and r["name_values"] == ["ONE", "TWO"]
    first = survivors(df, (F.col("k"), F.date_format("d", "yyyy-MM")), "key", "end", "d", "link", TRUST, "at", ("x",)).collect()
    assert sum(r["x"] % 1 == 0.5 for r in first) > 150


def test_a_hot_group_shrinks_to_one_claim_a_source(spark):
    """A third of all rows in one group: its rows are folded before they are shuffled."""
    hot = spark.range(30_000).select(F.col("id"), F.lit(1).alias("k"), F.lit("2020-01-05").cast("date").alias("d"), (F.col("id") % 5).cast("int").alias("key"), F.lit("2019-12-31").cast("date").alias("end"), F.lit("C").alias("link"), F.timestamp_micros(F.col("id")).alias("at"), F.lit("a").alias("name"), F.lit(1.0).alias("x"), F.lit("").alias("n_records"))
    r = run(hot).first()
    assert (r["n_records"], r["key"], r["key_first"], r["end"]) == (30_000, 29_999 % 5, True, dt.date(2019, 12, 31))
