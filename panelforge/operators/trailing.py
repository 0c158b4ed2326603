"""Totals and averages over trailing calendar spans, days without activity included."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelforge.functions.scalar import finite

#: A calendar has at most this many days (a thousand years); beyond it, it is not a calendar of days and is refused.
CALENDAR_LIMIT = 366_000


def daily_values(df: DataFrame, key: str, day: str, value: str, floor: float | None = None, latest: list[str] = ()) -> DataFrame:
    """One usable value for each (key, day): the last by ``latest`` (then the larger value), so revisions replace what they revise.

    Usable: key and day present, value finite and, with ``floor``, above it. A partial aggregation shrinks a hot key to its days.
    """
    v = finite(F.col(value))
    rows = df.select(F.col(key).alias("entity"), F.col(day).cast("date").alias("day"), v.alias("v"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(latest)])
    rows = rows.where(F.col("entity").isNotNull() & F.col("day").isNotNull() & F.col("v").isNotNull())
    if floor is not None:
        rows = rows.where(F.col("v") > floor)
    if not latest:
        return rows.groupBy("entity", "day").agg(F.max("v").alias("v"))
    order = F.struct(*[F.col(f"o{i}") for i in range(len(latest))], F.col("v"))
    return rows.groupBy("entity", "day").agg(F.max_by("v", order).alias("v"))


def trailing_prefix(values: DataFrame, calendar: DataFrame, spans: tuple[int, ...]) -> DataFrame:
    """Counts and totals over the last ``s`` calendar days, for each calendar day between an entity's first and last value.

    ``values``: entity, day, v, one row a day (``daily_values``). ``calendar``: distinct column ``day``. Prefix sums run over each
    entity's days, are carried forward to every date up to the next value, and a trailing total is the difference between the
    prefix at the day and the prefix ``s`` days before. All of it needs one shuffle on the entity.

    Result: entity, day, and ``n_s``, ``total_s`` (null if ``n_s`` is 0), ``mean_s`` for each span. Cases: an entity without usable
    values gives no rows; values on days outside the calendar count but get no row, and however far off they are, dates are
    only filled from the longest span before the calendar to its end; empty tables give no rows.
    """
    days = calendar_days(calendar)
    lo = F.lit(min(days, default=None)).cast("date")
    hi = F.lit(max(days, default=None)).cast("date")
    by_day = Window.partitionBy("entity").orderBy("day")
    running = by_day.rowsBetween(Window.unboundedPreceding, 0)
    prefix = values.select(
        "entity",
        "day",
        F.sum("v").over(running).alias("ps"),
        F.count("v").over(running).alias("pn"),
        F.lead("day").over(by_day).alias("nxt"),
    )
    since = F.greatest(F.col("day"), F.date_sub(lo, max(spans)))
    until = F.least(F.when(F.col("nxt").isNull(), F.col("day")).otherwise(F.date_sub("nxt", 1)), hi)
    held = prefix.select("entity", since.alias("since"), until.alias("until"), "ps", "pn").where(F.col("since") <= F.col("until"))
    dense = held.select("entity", F.explode(F.sequence("since", "until", F.expr("interval 1 day"))).alias("day"), "ps", "pn")
    out = dense
    for s in spans:
        out = out.withColumn(f"ln_{s}", F.coalesce(F.lag("pn", s).over(by_day), F.lit(0)))
        out = out.withColumn(f"ls_{s}", F.coalesce(F.lag("ps", s).over(by_day), F.lit(0.0)))
    cols = []
    for s in spans:
        n = (F.col("pn") - F.col(f"ln_{s}")).cast("long")
        total = F.when(n > 0, F.col("ps") - F.col(f"ls_{s}"))
        cols += [n.alias(f"n_{s}"), total.alias(f"total_{s}"), (total / F.when(n > 0, n)).alias(f"mean_{s}")]
    wanted = out.select("entity", "day", *cols)
    trading = values.sparkSession.createDataFrame([(d,) for d in sorted(days)], "day date")
    return wanted.join(F.broadcast(trading), "day", "left_semi")


def calendar_days(calendar: DataFrame) -> set:
    """The distinct days of a calendar, refused when they exceed ``CALENDAR_LIMIT``, so that a broadcast of them has a proven bound."""
    rows = calendar.where(F.col("day").isNotNull()).select("day").distinct().take(CALENDAR_LIMIT + 1)
    if len(rows) > CALENDAR_LIMIT:
        raise ValueError("the calendar has more days than CALENDAR_LIMIT")
    return {r[0] for r in rows}


def idle_spans(trailing: DataFrame, spans: tuple[int, ...]) -> DataFrame:
    """(entity, day, span) with no usable value in the span's days ending on that day."""
    pieces: Column = F.array(*[F.when(F.col(f"n_{s}") == 0, F.lit(s)) for s in spans])
    return trailing.select("entity", "day", F.explode(pieces).alias("span")).where(F.col("span").isNotNull())
