"""Closed date intervals per entity: merge into continuous periods, list gaps, membership joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def merge_intervals(
    df: DataFrame,
    key: str,
    start: str,
    end: str,
    lo: str | None = None,
    hi: str | None = None,
    open_end: str | None = None,
) -> DataFrame:
    """Continuous periods and the gaps between them.

    Each interval opens a session at its start whose duration is its own length, so Spark's ``session_window`` merges
    overlapping and nested ones; periods that touch are joined afterwards and gaps come from ``lead``.

    Result: ``entity`` (type of ``key``), ``kind`` ('period' or 'gap'), ``from_day`` and ``to_day`` (dates, both ends included).

    Cases: rows without key or start are ignored; a null end means ``open_end`` (without one, the row is ignored); dates are
    cut to ``lo``..``hi`` and what then ends before it starts is ignored; repeats and ties merge; an empty table gives no rows;
    other columns are never looked at. Before the sessions, rows shrink to the longest interval of each (key, start), a
    map-side combinable step that bounds every key by the number of days, so a key with a third of all rows is no hot spot.
    """
    s, e = F.col(start).cast("date"), F.col(end).cast("date")
    if open_end is not None:
        e = F.coalesce(e, F.lit(open_end).cast("date"))
    ok = s.isNotNull() & e.isNotNull()
    cut_s = F.greatest(s, F.lit(lo).cast("date")) if lo is not None else s
    cut_e = F.least(e, F.lit(hi).cast("date")) if hi is not None else e
    rows = df.where(F.col(key).isNotNull() & ok).select(F.col(key).alias("entity"), cut_s.alias("s"), cut_e.alias("e"))
    longest = rows.where(F.col("e") >= F.col("s")).groupBy("entity", "s").agg(F.max("e").alias("e"))
    gap = F.concat((F.datediff("e", "s") + 1).cast("string"), F.lit(" days"))
    sessions = (
        longest.select("entity", F.col("s").cast("timestamp_ntz").alias("ts"), gap.alias("gap"))
        .groupBy("entity", F.session_window("ts", F.col("gap")).alias("w"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select("entity", F.col("w.start").cast("date").alias("s"), F.col("w.end").cast("date").alias("e"))
    )
    order = Window.partitionBy("entity").orderBy("s")
    touching = sessions.withColumn("fresh", F.coalesce(F.col("s") > F.lag("e").over(order), F.lit(True)))
    periods = (
        touching.withColumn("island", F.sum(F.col("fresh").cast("int")).over(order))
        .groupBy("entity", "island")
        .agg(F.min("s").alias("s"), F.date_sub(F.max("e"), 1).alias("e"))
    )
    following = periods.withColumn("next_s", F.lead("s").over(order))
    pieces = F.array(
        F.struct(F.lit("period").alias("kind"), F.col("s").alias("from_day"), F.col("e").alias("to_day")),
        F.struct(F.lit("gap").alias("kind"), F.date_add("e", 1).alias("from_day"), F.date_sub("next_s", 1).alias("to_day")),
    )
    return following.select("entity", F.explode(pieces).alias("x")).select("entity", "x.*").where(F.col("to_day").isNotNull())


def membership_filter(df: DataFrame, intervals: DataFrame, key: str, day: str, ikey: str, start: str, end: str) -> DataFrame:
    """Rows of ``df`` whose day lies in some closed interval of their key; a semi join, so repeats never fan out."""
    i = intervals.select(F.col(ikey).alias("__ik"), F.col(start).alias("__is"), F.col(end).alias("__ie")).distinct()
    cond = (df[key] == i["__ik"]) & df[day].between(i["__is"], i["__ie"])
    return df.join(i, cond, "left_semi")


def first_interval_join(df: DataFrame, intervals: DataFrame, key: str, day: str, ikey: str, start: str, end: str) -> DataFrame:
    """As ``membership_filter`` but with the earliest covering interval's start and end beside each (key, day)."""
    i = intervals.select(F.col(ikey).alias("__ik"), F.col(start).alias("iv_start"), F.col(end).alias("iv_end"))
    hits = df.join(i, (df[key] == i["__ik"]) & df[day].between(i["iv_start"], i["iv_end"])).drop("__ik")
    w = Window.partitionBy(key, day).orderBy("iv_start", "iv_end")
    return hits.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def months_to_intervals(df: DataFrame, key: str, month_day: str) -> DataFrame:
    """Gaps and islands over months: runs of successive months become one interval (first day of the first month to the last of the last)."""
    m = df.where(F.col(key).isNotNull() & F.col(month_day).isNotNull()).select(F.col(key).alias("entity"), F.trunc(month_day, "MM").alias("m")).distinct()
    w = Window.partitionBy("entity").orderBy("m")
    fresh = F.coalesce(F.months_between("m", F.lag("m").over(w)) != 1, F.lit(True)).cast("int")
    runs = m.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(w))
    return runs.groupBy("entity", "island").agg(F.min("m").alias("start"), F.last_day(F.max("m")).alias("ending")).drop("island")


def expand_months(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """One row for each calendar month that a closed interval touches, repeats removed."""
    span = F.sequence(F.trunc(start, "MM"), F.trunc(end, "MM"), F.expr("interval 1 month"))
    return df.where(F.col(start) <= F.col(end)).select(F.col(key), F.explode(span).alias("month")).distinct()


def clip_intervals(df: DataFrame, key: str, start: str, end: str, lo: str, hi: str) -> DataFrame:
    """Null end means ``hi``; cut to the window, drop what is inverted, remove repeats."""
    s = F.greatest(F.col(start).cast("date"), F.lit(lo).cast("date"))
    e = F.least(F.coalesce(F.col(end).cast("date"), F.lit(hi).cast("date")), F.lit(hi).cast("date"))
    rows = df.where(F.col(key).isNotNull() & F.col(start).isNotNull()).select(F.col(key), s.alias("start"), e.alias("ending"))
    return rows.where(F.col("start") <= F.col("ending")).distinct()
