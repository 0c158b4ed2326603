"""Command line: convert raw files, build the panel, verify tables, run rolling forecasts, make tables.

python -m panelforge.plans.pipeline build TABLES OUT | verify TABLES | run TABLES OUT --first 2010-01 | tables OUT
"""

from __future__ import annotations

import argparse
import calendar
import logging
from dataclasses import fields

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from panelforge.functions.scalar import is_finite
from panelforge.models import em, gp, rolling
from panelforge.operators.windows import finite_profile, rank_transform
from panelforge.plans import evaluation, panel, prepare, tables
from panelforge.sources.readers import profile_folder
from panelforge.sources.writers import latex_table, write_csv, write_json, write_parquet

log = logging.getLogger("panelforge")


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def build_panel(spark: SparkSession, folder: str, out: str, least: int = 30) -> None:
    """Long characteristics, the ragged model panel and lagged covariates, each written once."""
    long = panel.characteristics(load(spark, folder, "ccm_merged"), load(spark, folder, "crsp_daily"), load(spark, folder, "sp500_index"))
    write_parquet(long, f"{out}/char_panel.parquet")
    long = load(spark, out, "char_panel")
    for row in finite_profile(long, list(panel.FEATURES)).collect():  # one row a feature
        log.log(logging.WARNING if row["n"] and row["n_bad"] > 0.4 * row["n"] else logging.INFO, "%s", row)
    rf = prepare.monthly_rf(spark, folder)
    dl = panel.delisting_returns(load(spark, folder, "delisting"))
    rows = panel.with_delisting(panel.with_excess(panel.universe(long, panel.members(load(spark, folder, "sp500_constituents"))), rf), dl)
    ranked = rank_transform(rows, "month", "PERMNO", list(panel.FEATURES)).where(is_finite(F.col("ex_ret")))
    write_parquet(ranked, f"{out}/ranked.parquet")
    write_parquet(panel.ragged(load(spark, out, "ranked"), "month", "PERMNO", "ex_ret", list(panel.FEATURES), least), f"{out}/panel.parquet")


def verify(spark: SparkSession, folder: str, names: tuple[str, ...] = ("ccm_merged", "crsp_daily", "delisting", "sp500_index", "sp500_constituents", "ff_factors", "ff_factors_daily")) -> DataFrame:
    return profile_folder(spark, {n: f"{folder}/{n}.parquet" for n in names})


def run(spark: SparkSession, folder: str, out: str, first: str, cfg: em.EMConfig, covariates: DataFrame, z_columns: list[str], vol_column: str, last: str | None = None, workers: int | None = None) -> None:
    """Rolling forecasts of the model and the baselines, regimes with their parameters, monthly factors and the configuration."""
    rows = load(spark, out, "ranked")
    forecasts, regimes = rolling.rolling_forecast(rows, covariates.select("month", *z_columns), covariates.select("month", vol_column), "month", "PERMNO", "ex_ret", list(panel.FEATURES), z_columns, vol_column, first, cfg, last, workers)
    baselines = rolling.rolling_baselines(rows, "month", "PERMNO", "ex_ret", list(panel.FEATURES), first, 800, 100, 500, 30, last)
    write_parquet(forecasts.withColumn("model", F.lit(MODEL)).unionByName(baselines, allowMissingColumns=True), f"{out}/predictions.parquet")
    write_parquet(evaluation.monthly_factors(spark, folder), f"{out}/factors.parquet")
    write_parquet(regimes, f"{out}/regimes.parquet")
    write_json(spark, cfg, f"{out}/config.json")


def fit_em_from_disk(spark: SparkSession, out: str, covariates: DataFrame, z_columns: list[str], vol_column: str, cfg: em.EMConfig = em.EMConfig()) -> tuple[em.EMResult, list]:
    """The model fitted on all months of a built panel that have complete covariates, and these months. The panel must fit the driver: SAMPLE_LIMIT numbers."""
    months = rolling.training_sample(load(spark, out, "ranked"), "month", "PERMNO", "ex_ret", list(panel.FEATURES), None)
    z = {x["month"]: x for x in covariates.select("month", *z_columns, vol_column).na.drop().collect()}  # a monthly series
    kept = [m for m in months if m[0] in z]
    fitted = em.fit_em([m[1] for m in kept], [m[2] for m in kept], np.array([[z[m[0]][c] for c in z_columns] for m in kept]), np.array([z[m[0]][vol_column] for m in kept]), cfg)
    return fitted, [m[0] for m in kept]


#: What the model is called in the tables.
MODEL = "Regime GP"


def make_tables(spark: SparkSession, out: str, other: str | None = None, label: str = "Regime GP (Matern 5/2)", tables_dir: str | None = None, figures_dir: str | None = None, first: str | None = None) -> str:
    """Both result tables and the data behind the figures. ``other``: a second run, with another kernel, whose rows join the tables under ``label``."""
    to, figures, since = tables_dir or out, figures_dir or tables_dir or out, F.col("month") >= (first or "0001-01-01")
    forecasts, regimes, factors = load(spark, out, "predictions").where(since), load(spark, out, "regimes").where(since), load(spark, out, "factors")
    t, p = tables.prediction_table(forecasts, regimes), tables.portfolio_table(forecasts, regimes, factors, evaluation.FF5)
    if other is not None:
        more = load(spark, other, "predictions").where(since & (F.col("model") == MODEL)).withColumn("model", F.lit(label))
        states = load(spark, other, "regimes").where(since)
        t2 = tables.prediction_table(more, states)
        p = p.unionByName(tables.portfolio_table(more, states, factors, evaluation.FF5))
        pair = t.where(F.col("model") == MODEL).withColumn("kernel", F.lit("main")).unionByName(t2.withColumns({"model": F.lit(MODEL), "kernel": F.lit("other")}))
        write_csv(tables.kernel_pairs(pair, "main", "other"), f"{figures}/kernels.csv")
        t = t.unionByName(t2).orderBy(F.col("overall").desc(), "model")
    write_csv(t, f"{to}/table_1.csv")
    write_csv(p, f"{to}/table_2.csv")
    write_csv(tables.alpha_bars(p), f"{figures}/alpha_bars.csv")
    write_csv(tables.lengthscale_means(regimes, list(panel.FEATURES)), f"{figures}/lengthscales.csv")
    episodes = spark.createDataFrame(evaluation.STRESS, "name string, lo string, hi string").select("name", F.to_date("lo").alias("lo"), F.to_date("hi").alias("hi"))
    write_csv(tables.stress_series(regimes, episodes), f"{figures}/stress.csv")
    return latex_table(t) + "\n" + latex_table(p)


def month_end(text: str | None) -> str | None:
    """The last day of a month given as yyyy-MM."""
    return None if text is None else f"{text}-{calendar.monthrange(int(text[:4]), int(text[5:7]))[1]:02d}"


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build")
    b.add_argument("tables")
    b.add_argument("out")
    b.add_argument("--least", type=int, default=30)
    v = sub.add_parser("verify")
    v.add_argument("tables")
    m = sub.add_parser("tables")
    m.add_argument("out")
    m.add_argument("--compare", help="folder of a run with another kernel")
    m.add_argument("--compare-label", default="Regime GP (Matern 5/2)")
    m.add_argument("--tables-dir")
    m.add_argument("--figures-dir")
    m.add_argument("--first", help="first month, yyyy-MM")
    r = sub.add_parser("run")
    r.add_argument("tables")
    r.add_argument("out")
    r.add_argument("--first", default="2010-01", help="first forecast month, yyyy-MM")
    r.add_argument("--last", help="last forecast month, yyyy-MM")
    r.add_argument("--workers", type=int, help="fits that may run at once")
    r.add_argument("--regimes", dest="n_regimes", type=int)
    r.add_argument("--kernel", choices=sorted(gp.KERNELS))
    for name in ("max-iter", "seed", "gp-restarts", "transition-restarts", "max-prediction-points"):
        r.add_argument(f"--{name}", type=int)
    for name in ("max-monthly-points", "max-months-per-regime"):
        r.add_argument(f"--{name}", type=int, help="0 for no bound")
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if a.command == "build":
        build_panel(spark, a.tables, a.out, a.least)
    elif a.command == "verify":
        verify(spark, a.tables).show(50, truncate=60)
    elif a.command == "tables":
        print(make_tables(spark, a.out, a.compare, a.compare_label, a.tables_dir, a.figures_dir, a.first and f"{a.first}-01"))
    else:
        macro = load(spark, a.tables, "fred_macro").withColumnRenamed("date", "month")
        z = panel.lagged_macro(macro, macro.select("month")).join(macro.select("month", "vix"), "month")
        run(spark, a.tables, a.out, f"{a.first}-01", configuration(a), z, [f"{c}_lag1" for c in panel.MACRO], "vix", month_end(a.last), a.workers)


def configuration(a: argparse.Namespace) -> em.EMConfig:
    """The published defaults with what the command line says; a bound of 0 is none."""
    given = {f.name: getattr(a, f.name) for f in fields(em.EMConfig) if getattr(a, f.name, None) is not None}
    return em.EMConfig(**{k: None if k.startswith("max_mon") and v == 0 else v for k, v in given.items()})


if __name__ == "__main__":
    main()
