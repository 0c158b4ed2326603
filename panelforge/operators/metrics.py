"""Forecast and portfolio metrics as aggregates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from panelforge.functions.scalar import safe_div
from panelforge.operators.windows import with_drawdown
from panelforge.session import ship_package


def oos_r2(actual: Column, prediction: Column) -> Column:
    """1 - SSE / sum of squares about zero; null where that sum is zero."""
    return 1 - safe_div(F.sum(F.pow(actual - prediction, 2)), F.sum(actual * actual))


def sharpe(r: Column) -> Column:
    return F.sqrt(F.lit(12.0)) * safe_div(F.avg(r), F.when(F.stddev_samp(r) > 0, F.stddev_samp(r)))


def annual_mean(r: Column) -> Column:
    return 12 * F.avg(r)


def annual_vol(r: Column) -> Column:
    return F.sqrt(F.lit(12.0)) * F.stddev_samp(r)


def max_drawdown(df: DataFrame, keys: list[str], time: str, ret: str) -> DataFrame:
    return with_drawdown(df, keys, time, ret).groupBy(*keys).agg(F.min("drawdown").alias("max_drawdown"))


def capm_alpha(r: Column, factor: Column) -> Column:
    """Twelve times the intercept on one factor; null below four months."""
    return F.when(F.count(r + factor) >= 4, 12 * F.regr_intercept(r, factor))


def factor_alpha(df: DataFrame, ret: str, factors: list[str], keys: list[str]) -> DataFrame:
    """Twelve times the intercept on several factors, from aggregated normal equations; null below factors + 3 months.

    Only the cross products of each key leave the executors' rows; the small systems are solved in place by an Arrow function.
    """
    ship_package(df.sparkSession)
    cols = [F.lit(1.0), *[F.col(f).cast("double") for f in factors], F.col(ret).cast("double")]
    ok = F.lit(True)
    for c in (*factors, ret):
        ok = ok & F.col(c).isNotNull()
    n = len(cols)
    sums = df.where(ok).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(cols[i] * cols[j]) for i in range(n) for j in range(n)]).alias("m"))

    @F.pandas_udf("double")
    def solve(m: pd.Series) -> pd.Series:
        out = []
        for x in m:
            a = np.asarray(x, float).reshape(n, n)
            out.append(12 * float(np.linalg.lstsq(a[:-1, :-1], a[:-1, -1], rcond=None)[0][0]))
        return pd.Series(out, dtype="float64")

    return sums.select(*keys, F.when(F.col("n") >= len(factors) + 3, solve("m")).alias("alpha"))


def long_short(df: DataFrame, keys: list[str], time: str, score: str, actual: str, entity: str, n: int = 10) -> DataFrame:
    """Equal-weighted top minus bottom bucket of each date by score; dates of fewer than ``n`` rows are left out."""
    part = [*keys, time]
    sized = df.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*part))).where(F.col("__n") >= n)
    placed = sized.withColumn("bucket", F.ntile(n).over(Window.partitionBy(*part).orderBy(score, entity)))
    top, low = F.col("bucket") == n, F.col("bucket") == 1
    legs = placed.where(top | low).groupBy(*part).agg(
        F.avg(F.when(top, F.col(actual))).alias("long_leg"), F.avg(F.when(low, F.col(actual))).alias("short_leg"), F.count_if(top).alias("n_long"), F.count_if(low).alias("n_short")
    )
    return legs.withColumn("long_short", F.col("long_leg") - F.col("short_leg"))

