"""Window operators on entity and time series panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from panelforge.functions.scalar import finite, is_finite, safe_div
from panelforge.operators.quantiles import exact_quantiles


def entity_window(entity: str, time: str) -> WindowSpec:
    return Window.partitionBy(entity).orderBy(time)


def lagged(c: Column, k: int, w: WindowSpec) -> Column:
    return F.lag(c, k).over(w)


def first_difference(c: Column, w: WindowSpec) -> Column:
    return c - F.lag(c).over(w)


def full_rolling(agg: Column, c: Column, w: WindowSpec, first: int, last: int) -> Column:
    """An aggregate over rows first..last, null unless the frame holds as many non-null values as rows."""
    frame = w.rowsBetween(first, last)
    return F.when(F.count(c).over(frame) == last - first + 1, agg.over(frame))


def momentum_12_1(ret: Column, w: WindowSpec) -> Column:
    """Compounded return over the rows t-12..t-2; a null return contributes nothing; null unless eleven rows lie there.

    A total loss among them gives -1, a return below it null.
    """
    growth = F.coalesce(F.when(ret > -1, F.log1p(ret)), F.lit(0.0))
    frame = w.rowsBetween(-12, -2)
    worst = F.coalesce(F.min(ret).over(frame), F.lit(0.0))
    value = F.when(worst > -1, F.expm1(F.sum(growth).over(frame))).when(worst == -1, F.lit(-1.0))
    return F.when(F.count(F.lit(1)).over(frame) == 11, value)


def with_residual_std(df: DataFrame, entity: str, time: str, y: str, x: str, out: str, rows: int = 60, least: int = 30, annual: float = 21.0) -> DataFrame:
    """Residual deviation of y on x and a constant over the last ``rows`` rows (n - 2 degrees of freedom), times the root of ``annual``.

    Running sums of the cross products, one update a row, are differenced ``rows`` rows apart, so the cost doesn't depend on the
    frame's length. Null below ``least`` complete rows. Without variance in x, y's own variance is used.
    """
    w = entity_window(entity, time)
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    ok = F.col(y).isNotNull() & F.col(x).isNotNull()
    terms = {"n": F.lit(1.0), "x": F.col(x), "y": F.col(y), "xx": F.col(x) * F.col(x), "xy": F.col(x) * F.col(y), "yy": F.col(y) * F.col(y)}
    sums = df.withColumns({f"__{k}": F.sum(F.when(ok, v).otherwise(0.0)).over(running) for k, v in terms.items()})
    moved = sums.withColumn("__before", F.lag(F.struct(*[f"__{k}" for k in terms]), rows).over(w))
    d = {k: F.col(f"__{k}") - F.coalesce(F.col(f"__before.__{k}"), F.lit(0.0)) for k in terms}
    sxx, syy, sxy = (d[k] - d[i] * d[j] / d["n"] for k, i, j in (("xx", "x", "x"), ("yy", "y", "y"), ("xy", "x", "y")))
    sse = F.when(sxx > 1e-14, syy - sxy * sxy / sxx).otherwise(syy)
    value = F.when(d["n"] >= least, F.sqrt(F.greatest(sse, F.lit(0.0)) / (d["n"] - 2)) * F.sqrt(F.lit(annual)))
    return moved.withColumn(out, value).drop("__before", *[f"__{k}" for k in terms])


def last_row_of_month(df: DataFrame, entity: str, time: str, *ties: Column) -> DataFrame:
    w = Window.partitionBy(entity, F.last_day(time)).orderBy(F.col(time).desc(), *ties)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def last_row(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order (so give descending columns for the last row).

    Spark limits each key's rows within every map task before they are shuffled (a partial WindowGroupLimit), so a hot key sends one row a task.
    """
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")


def rank_transform(df: DataFrame, time: str, entity: str, columns: list[str]) -> DataFrame:
    """Each column's rank within its date mapped to [-0.5, 0.5]: null and non-finite values to 0, a lone value to 0; ties by entity.

    All windows share one partitioning by date, so the cross-sections are shuffled once.
    """
    out = {}
    for c in columns:
        valid = is_finite(F.col(c))
        by = Window.partitionBy(time).orderBy(valid.desc(), F.col(c), F.col(entity))
        rank, n = F.row_number().over(by), F.sum(valid.cast("int")).over(Window.partitionBy(time))
        out[c] = F.when(~valid, 0.0).when(n <= 1, 0.0).otherwise((rank - 1) / (n - 1) - 0.5)
    return df.withColumns(out)


def fill_forward_backward(c: Column, w: WindowSpec) -> Column:
    before = F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(c, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return F.coalesce(before, after)


def drawdown(ret: Column, w: WindowSpec) -> Column:
    """Wealth over its running maximum, minus one. The maximum starts at the first wealth, so a first loss is no drawdown.

    Wealth is a running product of 1 + r, which also holds for r <= -1.
    """
    frame = w.rowsBetween(Window.unboundedPreceding, 0)
    return F.product(1 + ret).over(frame)


def with_drawdown(df: DataFrame, keys: list[str], time: str, ret: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(time)
    wealth = df.withColumn("wealth", drawdown(F.col(ret), w))
    peak = F.max("wealth").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return wealth.withColumn("drawdown", safe_div(F.col("wealth"), peak) - 1)


def buckets(df: DataFrame, time: str, score: str, entity: str, n: int = 10, out: str = "bucket") -> DataFrame:
    """Equal-count buckets 1..n of each date by score (ties by entity); the first buckets take what is left over."""
    return df.withColumn(out, F.ntile(n).over(Window.partitionBy(time).orderBy(score, entity)))


def top_per_group(df: DataFrame, group: str, n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows of each group; up to Spark's windowGroupLimitThreshold (1000 by default) every map task sends at most ``n`` rows a group."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("__rn") <= n).drop("__rn")


def expanding_mean(df: DataFrame, value: str, time: str, key: list[str] = ()) -> Column:
    """Mean of all rows before this one."""
    return F.avg(value).over(Window.partitionBy(*key).orderBy(time).rowsBetween(Window.unboundedPreceding, -1))


def compound_months(df: DataFrame, time: str, columns: list[str]) -> DataFrame:
    """Monthly compounded returns: product of 1 + r minus 1; one null day makes the month null; a month without days compounds to 0."""
    months = df.groupBy(F.last_day(time).alias("month")).agg(*[F.when(F.count(c) == F.count(F.lit(1)), F.product(1 + F.col(c)) - 1).alias(c) for c in columns])
    spine = months.agg(F.min("month").alias("lo"), F.max("month").alias("hi")).where("lo IS NOT NULL")
    all_months = spine.select(F.explode(F.sequence(F.trunc("lo", "MM"), F.trunc("hi", "MM"), F.expr("interval 1 month"))).alias("m")).select(F.last_day("m").alias("month"))
    had = months.withColumn("__had", F.lit(True))
    return all_months.join(had, "month", "left").select("month", *[F.when(F.col("__had"), F.col(c)).otherwise(F.lit(0.0)).alias(c) for c in columns])


def resample_last(df: DataFrame, time: str, columns: list[str]) -> DataFrame:
    """The last non-null value of each column in each month; months without rows come out with nulls."""
    months = df.groupBy(F.last_day(time).alias("month")).agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(time))).alias(c) for c in columns])
    spine = months.agg(F.min("month").alias("lo"), F.max("month").alias("hi")).where("lo IS NOT NULL")
    all_months = spine.select(F.explode(F.sequence(F.trunc("lo", "MM"), F.trunc("hi", "MM"), F.expr("interval 1 month"))).alias("m")).select(F.last_day("m").alias("month"))
    return all_months.join(months, "month", "left")


def finite_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows, nulls, non-finite share, mean, extremes and exact quantiles of each column, one row a column."""
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).isNull().alias("null"), finite(F.col(c)).alias("v")) for c in columns])
    long = df.select(F.explode(each).alias("x")).select("x.*")
    stats = long.groupBy("column").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("null").alias("n_null"), F.count_if(F.col("v").isNull()).alias("n_bad"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), F.min("v").alias("lo"), F.max("v").alias("hi")
    )
    return stats.join(F.broadcast(exact_quantiles(long, ["column"], "v", (0.01, 0.5, 0.99))), "column")  # one row a column


def ragged(df: DataFrame, time: str, entity: str, value: str, features: list[str], least: int = 30) -> DataFrame:
    """One row a date with parallel arrays ordered by entity; dates of fewer than ``least`` rows are left out.

    A date's cross-section is bounded by the number of entities of one day, which is what the model fits on.
    """
    cell = F.struct(F.col(entity).alias("e"), F.col(value).alias("r"), F.array(*[F.col(f) for f in features]).alias("x"))
    g = df.groupBy(time).agg(F.sort_array(F.collect_list(cell)).alias("c")).where(F.size("c") >= least)
    return g.select(time, F.col("c.e").alias("entities"), F.col("c.r").alias("returns"), F.col("c.x").alias("x"))
