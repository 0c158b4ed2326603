"""Attributes as known at event time: versioned as-of joins without range joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def asof_slots(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, slots: list[str]) -> DataFrame:
    """For each left row and each slot, the last non-null struct of that slot in the right rows of its key at or before its time.

    ``right``: key, right_time and one struct column a slot; a row may fill some slots only, so several lags of one feed share a pass.
    One union, one shuffle on the key, one sort and ``last`` windows; the result stays partitioned by the key. A right row at the
    same instant counts as known; among right rows at one instant the greatest struct wins. Left rows with a null key or time get
    nulls. Result: the left columns and the slots; left columns named like a slot are replaced.
    """
    lcols = [c for c in left.columns if c not in slots]
    others = [c for c in lcols if c != key]
    types = {f.name: f.dataType for f in [*left.schema.fields, *right.schema.fields]}
    kinds = {f.name: f.dataType for f in left.schema.fields}
    l = left.select(key, F.col(left_time).alias("__t"), F.lit(1).alias("__tag"), *others, *[F.lit(None).cast(types[s]).alias(s) for s in slots])
    known = right.where(F.col(key).isNotNull() & F.col(right_time).isNotNull())
    r = known.select(key, F.col(right_time).alias("__t"), F.lit(0).alias("__tag"), *[F.lit(None).cast(kinds[c]).alias(c) for c in others], *slots)
    w = Window.partitionBy(key).orderBy(F.col("__t").asc_nulls_first(), "__tag", *slots).rowsBetween(Window.unboundedPreceding, 0)
    both = l.unionByName(r).withColumns({s: F.last(s, ignorenulls=True).over(w) for s in slots}).where("__tag = 1")
    return both.select(*lcols, *slots)


def asof_backward(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, payload: list[str], suffix: str = "") -> DataFrame:
    """For each left row, the payload of the last right row of its key at or before its time (nulls if none), as ``asof_slots``.

    A left column named like a payload column is replaced. For keys that may hold unbounded left rows use ``version_join``, which
    numbers distinct instants only.
    """
    names = {c + suffix for c in payload}
    feed = right.select(key, F.col(right_time).alias("__rt"), F.struct(*payload).alias("__p"))
    joined = asof_slots(left, feed, key, left_time, "__rt", ["__p"])
    return joined.select(*[c for c in left.columns if c not in names], *[F.col(f"__p.{c}").alias(c + suffix) for c in payload])


def number_versions(versions: DataFrame, instants: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Number the states of each entity's best-known version and say which number holds at each instant.

    ``versions``: entity, known (date), rank (orderable struct: the greater is preferred once known). ``instants``: entity, at (date),
    distinct. Over the union of both, narrow rows in time order, a running maximum of ``rank`` is kept; the cumulative count of its
    changes is the version number. Result: (entity, number, rank) and (entity, at, number); number 0 means nothing known yet.
    """
    rank_type = versions.schema["rank"].dataType
    timeline = versions.select("entity", F.col("known").alias("t"), F.lit(0).alias("tag"), "rank").unionByName(
        instants.select("entity", F.col("at").alias("t"), F.lit(1).alias("tag"), F.lit(None).cast(rank_type).alias("rank"))
    )
    order = Window.partitionBy("entity").orderBy("t", "tag", "rank")
    best_before = F.max("rank").over(order.rowsBetween(Window.unboundedPreceding, -1))
    change = (F.col("tag") == 0) & (best_before.isNull() | (F.col("rank") > best_before))
    numbered = timeline.withColumn("change", change.cast("int")).withColumn("number", F.sum("change").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    states = numbered.where("change = 1").select("entity", "number", "rank")
    at = numbered.where("tag = 1").select("entity", F.col("t").alias("at"), "number")
    return states, at


def version_join(events: DataFrame, entity: str, at: str, versions: DataFrame, attributes: list[str]) -> DataFrame:
    """Every event with the attributes of the version in force at its time, by an equi-join on entity and version number.

    ``versions``: entity, known, rank and the ``attributes``; (entity, known, rank) should be unique, else the greatest attributes win.
    The time line holds distinct (entity, instant) pairs only, so an entity with a third of all events is bounded by its days;
    wide attributes travel only in the last equi-joins. Events with a null entity or time, or before anything is known, keep null
    attributes. Event columns stay; attributes are named ``known_<name>`` and replace event columns of that name.
    """
    usable = versions.where(F.col("entity").isNotNull() & F.col("known").isNotNull() & F.col("rank").isNotNull())
    narrow = usable.groupBy("entity", "rank").agg(F.min("known").alias("known"), F.max(F.struct(*attributes)).alias("attrs"))
    instants = events.where(F.col(entity).isNotNull() & F.col(at).isNotNull()).select(F.col(entity).alias("entity"), F.col(at).alias("at")).distinct()
    states, numbers = number_versions(narrow.select("entity", "known", "rank"), instants)
    attrs = states.join(narrow.drop("known"), ["entity", "rank"]).select(F.col("entity").alias("__ve"), F.col("number").alias("__vn"), F.col("attrs").alias("__attrs"))
    numbers = numbers.select(F.col("entity").alias("__ne"), F.col("at").alias("__na"), F.col("number").alias("__nn"))
    names = [f"known_{c}" for c in attributes]
    kept = [c for c in events.columns if c not in names]
    e = events.select(*kept)
    out = e.join(numbers, (e[entity] == numbers["__ne"]) & (e[at] == numbers["__na"]), "left")
    out = out.join(attrs, (F.col("__ne") == attrs["__ve"]) & (F.col("__nn") == attrs["__vn"]), "left")
    return out.select(*[e[c] for c in kept], *[F.col(f"__attrs.{c}").alias(n) for c, n in zip(attributes, names)])


def known_from(published: Column, period_end: Column, months: int = 6) -> Column:
    """The day from which a figure is public: its publication day or, where that is null, ``months`` after the period's end (same day or the month's last)."""
    return F.coalesce(published.cast("date"), F.add_months(period_end.cast("date"), months))
