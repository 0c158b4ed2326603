"""The engine's functions under the names that users of panel regime models know."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelforge.models.em import EMConfig, EMResult, fit_em, predict_next, regime_states
from panelforge.models.gp import GPParams, fit, log_likelihood, matern52_ard, predict, se_ard
from panelforge.models.hmm import backward_log, fit_transitions, forward_log, kmeans_1d, log_transitions, posteriors, viterbi
from panelforge.models.rolling import rolling_baselines, rolling_forecast
from panelforge.operators.metrics import capm_alpha, factor_alpha, long_short, oos_r2, sharpe
from panelforge.plans.panel import aligned_panel, characteristics, lagged_macro, model_panel, volatility_proxy
from panelforge.plans.pipeline import build_panel, fit_em_from_disk

predict_next_month = predict_next
initialize_regimes = regime_states
fit_gp_hyperparameters = fit
marginal_log_likelihood = log_likelihood
log_transition_matrix = log_transitions
fit_logistic_weighted = fit_transitions
pooled_oos_r2 = oos_r2
sharpe_ratio = sharpe
run_baselines_rolling = rolling_baselines
build_char_panel = characteristics
build_macro_panel = lagged_macro
load_aligned_panel = aligned_panel
build_and_save = build_panel

FIVE = ("mkt", "smb", "hml", "rmw", "cma")


def load_panel(spark: SparkSession, out: str) -> DataFrame:
    """The ragged model panel of a folder: month, entities, returns, x."""
    return spark.read.parquet(f"{out}/panel.parquet")


def initialize_from_volatility_proxy(index: DataFrame, months: list, n_regimes: int = 2):
    """States and one-hot responsibilities of the given months by k-means on the index's volatility; a month without it is refused."""
    found = {r["month"]: r["vol"] for r in volatility_proxy(index).select("month", "vol").collect()}  # a monthly series
    if any(found.get(m) is None for m in months):
        raise ValueError("months without a volatility")
    return regime_states([found[m] for m in months], n_regimes)


def regime_conditional_oos_r2(forecasts: DataFrame, state: str = "state") -> DataFrame:
    """R2 about zero of the forecasts (actual, prediction) within each state."""
    return forecasts.where(F.col(state).isNotNull()).groupBy(state).agg(oos_r2(F.col("actual"), F.col("prediction")).alias("r2"))


def ff5_alpha(returns: DataFrame, factors: DataFrame, ret: str = "long_short") -> float | None:
    """Twelve times the intercept of monthly returns on the five factors, joined by month; None below eight months."""
    joined = returns.join(F.broadcast(factors.select("month", *FIVE)), "month").withColumn("__all", F.lit(1))  # a monthly series
    row = factor_alpha(joined, ret, list(FIVE), ["__all"]).first()
    return None if row is None else row["alpha"]


def decile_long_short_from_frame(forecasts: DataFrame, n: int = 10) -> DataFrame:
    """Monthly long-short returns of one model's forecasts (month, entity, prediction, actual)."""
    return long_short(forecasts, [], "month", "prediction", "actual", "entity", n)


__all__ = [
    "EMConfig", "EMResult", "GPParams", "aligned_panel", "backward_log", "build_and_save", "build_char_panel", "build_macro_panel", "capm_alpha", "characteristics", "decile_long_short_from_frame", "factor_alpha",
    "ff5_alpha", "fit", "fit_em", "fit_em_from_disk", "fit_gp_hyperparameters", "fit_logistic_weighted", "fit_transitions", "forward_log", "initialize_from_volatility_proxy", "initialize_regimes", "kmeans_1d", "lagged_macro",
    "load_aligned_panel", "load_panel", "log_likelihood", "log_transition_matrix", "log_transitions", "long_short", "marginal_log_likelihood", "matern52_ard", "model_panel", "oos_r2", "pooled_oos_r2", "posteriors", "predict",
    "predict_next", "predict_next_month", "regime_conditional_oos_r2", "regime_states", "rolling_baselines", "rolling_forecast", "run_baselines_rolling", "se_ard", "sharpe", "sharpe_ratio", "viterbi", "volatility_proxy",
]
