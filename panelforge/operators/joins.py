"""Joins of panels and series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from panelforge.session import cut_lineage

#: Rows up to which a side may be broadcast, checked before it is.
BROADCAST_ROWS = 100_000


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a side for broadcast after checking that it has at most ``limit`` rows; beyond that it is left to the planner."""
    return F.broadcast(df) if len(df.select(F.lit(1)).take(limit + 1)) <= limit else df


def settled(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A small result written to the checkpoint folder once; broadcast where its counted rows are at most ``limit``, else an ordinary side."""
    kept = cut_lineage(df)
    return F.broadcast(kept) if kept.count() <= limit else kept


def month_end_join(left: DataFrame, right: DataFrame, left_day: str, right_day: str, columns: list[str]) -> DataFrame:
    """Left join of days to monthly figures on the calendar month end."""
    r = right.select(F.last_day(right_day).alias("__me"), *columns)
    return left.withColumn("__l", F.last_day(left_day)).join(r, F.col("__l") == F.col("__me"), "left").drop("__l", "__me")


def outer_series(series: list[DataFrame], on: str) -> DataFrame:
    """Full outer join of several series on their date."""
    return reduce(lambda a, b: a.join(b, on, "full_outer"), series)


def override(left: DataFrame, right: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
    """Full outer join where a right figure replaces the left one of the same name wherever it is present."""
    r = right.select(*on, *[F.col(c).alias(f"__r_{c}") for c in columns])
    joined = left.select(*on, *columns).join(r, on, "full_outer")
    return joined.select(*on, *[F.coalesce(f"__r_{c}", c).alias(c) for c in columns])


def shared_ids(a: DataFrame, b: DataFrame, column_a: str, column_b: str) -> DataFrame:
    return a.select(F.col(column_a).alias("id")).intersect(b.select(F.col(column_b).alias("id")))
