"""Result tables and the data behind figures, from stored forecasts and regimes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from panelforge.functions.scalar import safe_div
from panelforge.operators import metrics


def state_column(regimes: DataFrame) -> str:
    """Predicted states where there are any, else those of the likeliest path."""
    return "predicted_state" if "predicted_state" in regimes.columns else "viterbi_state"


def with_states(forecasts: DataFrame, regimes: DataFrame) -> DataFrame:
    """Forecasts (month, entity, model, prediction, actual) with the state of their month; one regime row a month."""
    return forecasts.join(F.broadcast(regimes.select("month", F.col(state_column(regimes)).alias("state"))), "month", "left")


def prediction_table(forecasts: DataFrame, regimes: DataFrame, n_states: int = 2) -> DataFrame:
    """R2 of each model over all months and within each state, best first."""
    j = with_states(forecasts, regimes)

    def of(cond) -> object:
        sse = F.sum(F.when(cond, F.pow(F.col("actual") - F.col("prediction"), 2)))
        return 1 - safe_div(sse, F.sum(F.when(cond, F.col("actual") * F.col("actual"))))

    cols = [of(F.col("state") == k).alias(f"regime_{k}") for k in range(n_states)]
    return j.groupBy("model").agg(metrics.oos_r2(F.col("actual"), F.col("prediction")).alias("overall"), *cols).orderBy(F.col("overall").desc(), "model")


def portfolio_table(forecasts: DataFrame, regimes: DataFrame, factors: DataFrame, five: list[str], n: int = 10) -> DataFrame:
    """Mean, volatility, Sharpe ratio, alphas and worst drawdown of each model's long-short returns, overall (state -1) and by state."""
    p = metrics.long_short(forecasts, ["model"], "month", "prediction", "actual", "entity", n).select("model", "month", "long_short")
    s = regimes.select("month", F.col(state_column(regimes)).alias("state"))
    both = p.withColumn("state", F.lit(-1)).unionByName(p.join(F.broadcast(s), "month"))
    keys, x = ["model", "state"], F.col("long_short")
    main = both.groupBy(*keys).agg(F.count(F.lit(1)).alias("months"), metrics.annual_mean(x).alias("ann_return"), metrics.annual_vol(x).alias("ann_vol"), metrics.sharpe(x).alias("sharpe"))
    exposed = both.join(F.broadcast(factors), "month")
    capm = exposed.groupBy(*keys).agg(metrics.capm_alpha(x, F.col(five[0])).alias("capm_alpha"))
    ff = metrics.factor_alpha(exposed, "long_short", five, keys).withColumnRenamed("alpha", "ff5_alpha")
    fall = metrics.max_drawdown(both, keys, "month", "long_short")
    return main.join(capm, keys, "left").join(ff, keys, "left").join(fall, keys, "left").orderBy(*keys)


def lengthscale_means(regimes: DataFrame, features: list[str]) -> DataFrame:
    """Mean length scale of each regime and feature over all fits."""
    by_regime = regimes.select(F.posexplode("lengthscales").alias("regime", "ls"))
    by_feature = by_regime.select("regime", F.posexplode("ls").alias("pos", "v"))
    names = F.array(*[F.lit(f) for f in features])
    return by_feature.groupBy("regime", "pos").agg(F.avg("v").alias("lengthscale")).select("regime", F.element_at(names, F.col("pos") + 1).alias("feature"), "lengthscale")


def stress_series(regimes: DataFrame, episodes: DataFrame, state: int = 1) -> DataFrame:
    """Probability of a state over time with the stress episode (name, lo, hi) it falls into."""
    p = regimes.select("month", F.element_at("next_probs", state + 1).alias("probability"))
    return p.join(F.broadcast(episodes), F.col("month").between(F.col("lo"), F.col("hi")), "left").select("month", "probability", "name")


def kernel_pairs(tables: DataFrame, base: str, other: str) -> DataFrame:
    """R2 under two kernels side by side: rows of a prediction table with a column ``kernel``."""
    a = tables.where(F.col("kernel") == base).select("model", *[F.col(c).alias(f"{c}_{base}") for c in ("overall", "regime_0", "regime_1")])
    b = tables.where(F.col("kernel") == other).select("model", *[F.col(c).alias(f"{c}_{other}") for c in ("overall", "regime_0", "regime_1")])
    return a.join(b, "model")


def alpha_bars(portfolio: DataFrame) -> DataFrame:
    """Alphas of all months in per cent."""
    return portfolio.where("state = -1").select("model", (100 * F.col("capm_alpha")).alias("capm_pct"), (100 * F.col("ff5_alpha")).alias("ff5_pct"))
