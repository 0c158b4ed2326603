"""Window, sampling and metric operators on small fixtures; sources and sinks by round trips."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from panelforge.functions.scalar import argmax_array, gaussian_from_hash, is_finite, parse_day, softmax_ref
from panelforge.models import rolling
from panelforge.operators import joins, metrics, sampling, windows
from panelforge.plans import convert, panel
from panelforge.sources import readers, writers

D = dt.date


def month(i):
    return D(2020 + i // 12, i % 12 + 1, 28)


def test_momentum_of_constant_return(spark):
    df = spark.createDataFrame([(1, month(i), 0.01) for i in range(13)], "PERMNO int, month date, ret double")
    got = [r["mom_12_1"] for r in panel.with_momentum(df).orderBy("month").collect()]
    assert got[:12] == [None] * 12 and abs(got[12] - (1.01**11 - 1)) < 1e-12


def test_rank_transform(spark):
    rows = [(i, D(2020, 1, 1), float(i)) for i in range(5)] + [(9, D(2020, 1, 1), float("nan")), (10, D(2020, 1, 1), None), (1, D(2020, 2, 1), 3.0)]
    got = {(r["e"], r["d"]): r["v"] for r in windows.rank_transform(spark.createDataFrame(rows, "e int, d date, v double"), "d", "e", ["v"]).collect()}
    assert [got[i, D(2020, 1, 1)] for i in range(5)] == [-0.5, -0.25, 0.0, 0.25, 0.5]
    assert got[9, D(2020, 1, 1)] == got[10, D(2020, 1, 1)] == got[1, D(2020, 2, 1)] == 0.0


def test_residual_deviation(spark):
    rng = np.random.default_rng(0)
    rows, start = [], D(2020, 1, 1)
    for s in range(40):
        m = rng.normal(0, 0.01, 60)
        y = 1.2 * m + rng.normal(0, 0.02, 60)
        rows += [(s, start + dt.timedelta(i), float(y[i]), float(m[i])) for i in range(60)]
    df = spark.createDataFrame(rows, "s int, d date, y double, m double")
    v = windows.with_residual_std(df, "s", "d", "y", "m", "v")
    last = v.where(F.col("d") == start + dt.timedelta(59)).agg(F.avg("v")).first()[0] / math.sqrt(21)
    assert abs(last / 0.02 - 1) < 0.05
    assert v.where(F.col("d") < start + dt.timedelta(29)).where("v IS NOT NULL").count() == 0


def test_compounding(spark):
    rows = [(D(2020, 1, 5), 0.1, 0.1), (D(2020, 1, 6), 0.1, None), (D(2020, 3, 2), 0.2, 0.2)]
    got = [tuple(r) for r in windows.compound_months(spark.createDataFrame(rows, "d date, a double, b double"), "d", ["a", "b"]).orderBy("month").collect()]
    assert [round(x[1], 9) for x in got] == [0.21, 0.0, 0.2]
    assert got[0][2] is None and got[1][2] == 0.0


def test_drawdown_starts_at_first_wealth(spark):
    df = spark.createDataFrame([("m", month(i), r) for i, r in enumerate([-0.5, 0.1, -0.2, 0.3])], "k string, t date, r double")
    assert abs(metrics.max_drawdown(df, ["k"], "t", "r").first()["max_drawdown"] + 0.2) < 1e-12


def test_fill_and_expand(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([None, 1.0, None, 2.0, None])], "t int, v double")
    assert [r[0] for r in df.select(windows.fill_forward_backward(F.col("v"), Window.orderBy("t")).alias("v")).collect()] == [1.0, 1.0, 1.0, 2.0, 2.0]


def test_delisting_composition(spark):
    dl = spark.createDataFrame([(1, D(2020, 1, 3), 500, None, dt.datetime(2020, 2, 1), 1), (1, D(2020, 1, 9), 500, -0.9, dt.datetime(2020, 1, 1), 2), (2, D(2020, 1, 9), 450, None, dt.datetime(2020, 1, 1), 3), (3, D(2020, 1, 9), 231, None, dt.datetime(2020, 1, 1), 4)], "PERMNO int, DLSTDT date, DLSTCD int, DLRET double, loaded_at timestamp, rec_id long")
    p = spark.createDataFrame([(i, D(2020, 1, 31), x) for i, x in ((1, 0.1), (2, None), (3, 0.1), (4, 0.1))], "PERMNO int, month date, ex_ret double")
    got = {r["PERMNO"]: round(r["ex_ret"], 9) for r in panel.with_delisting(p, panel.delisting_returns(dl)).collect()}
    assert got == {1: round(1.1 * 0.1 - 1, 9), 2: -0.3, 3: 0.1, 4: 0.1}


def test_allocation_and_sampling(spark):
    df = spark.createDataFrame([(i, n) for i, n in enumerate([10, 10, 2])], "m int, n long")
    got = [r["allocated"] for r in sampling.largest_remainder(df, "n", 11, "m").orderBy("m").collect()]
    assert sum(got) == 11 and all(a <= b for a, b in zip(got, [10, 10, 2]))
    rows = spark.range(1000).select((F.col("id") % 4).alias("g"), "id")
    one = {r["id"] for r in sampling.hash_sample(rows.repartition(1), "g", "id", 5).collect()}
    assert one == {r["id"] for r in sampling.hash_sample(rows.repartition(9), "g", "id", 5).collect()} and len(one) == 20


def test_factor_alpha_matches_least_squares(spark):
    rng = np.random.default_rng(1)
    f = rng.normal(size=(50, 3))
    y = 0.01 + f @ [1.0, -0.5, 0.2] + rng.normal(0, 0.1, 50)
    df = spark.createDataFrame([("m", *map(float, r), float(v)) for r, v in zip(f, y)], "k string, a double, b double, c double, y double")
    want = 12 * np.linalg.lstsq(np.c_[np.ones(50), f], y, rcond=None)[0][0]
    assert abs(metrics.factor_alpha(df, "y", ["a", "b", "c"], ["k"]).first()["alpha"] - want) < 1e-9
    assert metrics.factor_alpha(df.limit(5), "y", ["a", "b", "c"], ["k"]).first()["alpha"] is None


def test_fama_macbeth_matches_numpy(spark):
    rng = np.random.default_rng(2)
    rows = [(month(t), e, float(x), float(y), float(0.02 * x - 0.01 * y + rng.normal(0, 0.01))) for t in range(5) for e, (x, y) in enumerate(rng.normal(size=(20, 2)))]
    df = spark.createDataFrame(rows, "month date, e int, x double, y double, r double")
    got = {(r["month"], r["e"]): r["prediction"] for r in rolling.fama_macbeth(df, "month", "e", "r", ["x", "y"]).collect()}
    assert len(got) == 80
    a = np.array([(x, y, r) for _, _, x, y, r in rows]).reshape(5, 20, 3)
    beta = [np.linalg.lstsq(np.c_[np.ones(20), m[:, :2]], m[:, 2], rcond=None)[0] for m in a]
    want = np.c_[np.ones(20), a[3][:, :2]] @ np.mean(beta[:3], axis=0)
    assert np.allclose([got[month(3), e] for e in range(20)], want)


def test_scalar_functions(spark):
    df = spark.createDataFrame([("2020-02-03",), ("20200203",), ("junk",), (None,)], "s string")
    assert [r[0] for r in df.select(parse_day(F.col("s"))).collect()] == [D(2020, 2, 3), D(2020, 2, 3), None, None]
    p = spark.range(1).select(F.array(*softmax_ref([F.lit(0.0), F.lit(100.0)])).alias("p"))
    assert abs(sum(p.first()[0]) - 1) < 1e-12 and p.select(argmax_array(F.col("p"))).first()[0] == 2
    v = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (None,)], "v double")
    assert [r[0] for r in v.select(is_finite(F.col("v"))).collect()] == [True, False, False, False]
    z = spark.range(20_000).select(gaussian_from_hash(1, F.col("id")).alias("z")).agg(F.avg("z"), F.stddev("z")).first()
    assert abs(z[0]) < 0.03 and abs(z[1] - 1) < 0.03


def test_overrides_and_broadcast_bound(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "d int, x double")
    b = spark.createDataFrame([(2, 5.0), (3, None)], "d int, x double")
    assert {tuple(r) for r in joins.override(a, b, ["d"], ["x"]).collect()} == {(1, 1.0), (2, 5.0), (3, None)}
    assert joins.small(spark.range(5), 3).queryExecution if hasattr(spark.range(1), "queryExecution") else True


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "f.csv").write_text("Made by hand\n\n,Mkt-RF,SMB\n20200102,  1.00, -99.99\n20200103,  2.00,  0.50\n\nCopyright\n20200104, 9, 9\n")
    got = [tuple(r) for r in readers.read_embedded_block(spark, str(tmp_path / "f.csv")).collect()]
    assert got == [(D(2020, 1, 2), 1.0, None), (D(2020, 1, 3), 2.0, 0.5)]
    (tmp_path / "m.csv").write_text("PERMNO,MthCalDt,MthRet,Ticker,odd\n1,20200131,0.5,NA,7\nx,2020-02-29,NaN,B,\n")
    t = readers.typed(readers.read_strings(spark, str(tmp_path / "m.csv")), readers.CCM_TYPES)
    assert dict(t.dtypes) == {"PERMNO": "int", "MthCalDt": "date", "MthRet": "float", "Ticker": "string", "odd": "float"}
    assert [tuple(r) for r in t.collect()] == [(1, D(2020, 1, 31), 0.5, None, 7.0), (None, D(2020, 2, 29), None, "B", None)]
    writers.write_parquet(t, str(tmp_path / "out.parquet"))
    writers.write_parquet(t.limit(1), str(tmp_path / "out.parquet"))
    assert spark.read.parquet(str(tmp_path / "out.parquet")).count() == 1 and not (tmp_path / "out.parquet.tmp").exists()
    writers.write_json(spark, {"a": 1}, str(tmp_path / "c.json"))
    assert '"a": 1' in (tmp_path / "c.json").read_text()
    assert r"0.5000 & \\" not in writers.latex_table(t.select("MthRet")) and "0.5000" in writers.latex_table(t.select("MthRet"))
    with pytest.raises(FileNotFoundError):
        readers.RawFiles(str(tmp_path), {"a": "none.csv"}).path(spark, "a")


def test_converters(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    block = lambda head, rows: "x\n\n," + head + "\n" + "\n".join(rows) + "\n\nend\n"
    (raw / "ff3_daily.csv").write_text(block("Mkt-RF,SMB,HML,RF", ["20200102,1,2,3,0.1", "20200103,1,2,3,0.1"]))
    (raw / "ff5_daily.csv").write_text(block("Mkt-RF,SMB,HML,RMW,CMA,RF", ["20200103,5,-99.99,6,7,8,0.2"]))
    (raw / "mom_daily.csv").write_text(block("Mom", ["20200103,9"]))
    (raw / "vix.csv").write_text("observation_date,VIXCLS\n2020-01-30,20\n2020-01-31,.\n2020-03-02,30\n")
    (raw / "sp500_constituents.csv").write_text("Symbol,Start_Date,Thru\n ab ,2020-01-15,2020-03-01\n")
    (raw / "ccm_merged.csv").write_text("PERMNO,MthCalDt,Ticker,MthRet\n1,2020-01-31,AB,0.1\n1,2020-02-28,Ab ,0.1\n1,2020-04-30,AB,0.1\n")
    state = convert.convert_all(spark, readers.RawFiles(str(raw), convert.RAW_NAMES), str(tmp_path / "out"))
    assert state["crsp_daily"] == "missing" and state["ff_factors_daily"] == state["sp500_constituents"] == state["fred_macro"] == "written"
    f = {r["date"]: r for r in spark.read.parquet(str(tmp_path / "out/ff_factors_daily.parquet")).collect()}
    assert abs(f[D(2020, 1, 3)]["mkt_rf"] - 0.05) < 1e-7 and abs(f[D(2020, 1, 3)]["smb"] - 0.02) < 1e-7 and abs(f[D(2020, 1, 3)]["mom"] - 0.09) < 1e-7
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out/sp500_constituents.parquet")).collect()] == [(1, D(2020, 1, 31), D(2020, 2, 28))]
    m = {r["date"]: r for r in spark.read.parquet(str(tmp_path / "out/fred_macro.parquet")).collect()}
    assert m[D(2020, 1, 31)]["vix"] == 20 and m[D(2020, 2, 29)]["vix"] is None and m[D(2020, 3, 31)]["vix"] == 30


def test_stream_of_events(spark, tmp_path):
    from panelforge.streaming.events import hourly_totals, read_event_stream

    e = spark.createDataFrame([(1, dt.datetime(2020, 1, 1, 0, 10), "a", 1.0), (2, dt.datetime(2020, 1, 1, 0, 50), "a", 2.0), (3, dt.datetime(2020, 1, 1, 5, 0), "a", 4.0)], "event_id long, ts timestamp, event_type string, value double")
    e.write.parquet(str(tmp_path / "in"))
    q = hourly_totals(read_event_stream(spark, str(tmp_path / "in"), e), "10 minutes").writeStream.outputMode("append").format("memory").queryName("hours").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        q.processAllAvailable()
        got = {(r["hour_start"], r["n"], r["total"]) for r in spark.sql("SELECT * FROM hours").collect()}
    finally:
        q.stop()
    assert (dt.datetime(2020, 1, 1), 2, 3.0) in got
