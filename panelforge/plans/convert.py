"""Raw files to typed tables, one converter a table; a missing file is skipped with a warning, another error doesn't stop the rest."""

from __future__ import annotations

import argparse
import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelforge.operators.intervals import clip_intervals
from panelforge.operators.joins import override
from panelforge.operators.windows import compound_months, first_difference, resample_last
from panelforge.plans.panel import PANEL_END, PANEL_START, ticker_membership
from panelforge.sources.readers import CCM_TYPES, DAILY_TYPES, RawFiles, Types, first_alias, read_embedded_block, read_series, read_strings, typed
from panelforge.functions.scalar import parse_day
from panelforge.sources.writers import logged, write_parquet
from pyspark.sql import Window

log = logging.getLogger("panelforge")

#: The factor library's column names and ours.
FACTOR_NAMES = {"Mkt-RF": "mkt_rf", "SMB": "smb", "HML": "hml", "RMW": "rmw", "CMA": "cma", "RF": "rf", "Mom": "mom"}
RAW_NAMES = {
    "ccm_merged": "ccm_merged.csv", "crsp_daily": "crsp_daily.csv", "delisting": "delisting.csv", "sp500_index": "sp500_index.csv", "ff3": "ff3_daily.csv", "ff5": "ff5_daily.csv", "mom": "mom_daily.csv",
    "constituents": "sp500_constituents.csv", "vix": "vix.csv", "baa": "baa.csv", "aaa": "aaa.csv", "gs10": "gs10.csv", "tb3ms": "tb3ms.csv",
}


def merged_months(spark: SparkSession, raw: RawFiles) -> DataFrame:
    return typed(read_strings(spark, raw.path(spark, "ccm_merged")), CCM_TYPES)


def daily(spark: SparkSession, raw: RawFiles) -> DataFrame:
    t = typed(read_strings(spark, raw.path(spark, "crsp_daily")), DAILY_TYPES)
    return t.withColumn("RET", F.col("RET").try_cast("float")) if "RET" in t.columns else t


def delistings(spark: SparkSession, raw: RawFiles) -> DataFrame:
    return typed(read_strings(spark, raw.path(spark, "delisting")), Types(dates=frozenset({"DLSTDT"}), ints=frozenset({"PERMNO", "DLSTCD"}), texts=frozenset({"src"})))


def index_days(spark: SparkSession, raw: RawFiles) -> DataFrame:
    return typed(read_strings(spark, raw.path(spark, "sp500_index")), Types(dates=frozenset({"caldt"}), ints=frozenset({"totcnt", "usdcnt"})))


def factor_days(spark: SparkSession, raw: RawFiles) -> DataFrame:
    """The five-factor file overrides the three-factor file where both have a figure; momentum is joined on; per cent become fractions."""
    parts = []
    for key in ("ff3", "ff5", "mom"):
        t = read_embedded_block(spark, raw.path(spark, key))
        parts.append(t.select("date", *[(F.col(f"`{c}`") / 100.0).alias(FACTOR_NAMES[c]) for c in t.columns if c in FACTOR_NAMES]))
    three, five, mom = parts
    shared = [c for c in three.columns if c in five.columns and c != "date"]
    both = override(three, five, ["date"], shared).join(five.drop(*shared), "date", "left")
    out = both.join(mom, "date", "full_outer")
    return out.select("date", *[F.col(c).cast("float").alias(c) for c in FACTOR_NAMES.values() if c in out.columns])


def factor_months(spark: SparkSession, raw: RawFiles) -> DataFrame:
    d = factor_days(spark, raw)
    cols = [c for c in d.columns if c != "date"]
    return compound_months(d.select("date", *[F.col(c).cast("double").alias(c) for c in cols]), "date", cols).withColumnRenamed("month", "date")


def macro_months(spark: SparkSession, raw: RawFiles) -> DataFrame:
    """Month-end values, credit and term spreads, and the change of the volatility index; series that are missing are left out."""
    paths = {}
    for name in ("vix", "baa", "aaa", "gs10", "tb3ms"):
        try:
            paths[name] = raw.path(spark, name)
        except FileNotFoundError:
            log.warning("no series %s", name)
    if not paths:
        raise FileNotFoundError("no macro series")
    m = resample_last(read_series(spark, paths), "date", list(paths)).withColumnRenamed("month", "date")
    if "vix" in paths:
        m = m.withColumn("vix_chg", first_difference(F.col("vix"), Window.orderBy("date")))
    if {"baa", "aaa"} <= set(paths):
        m = m.withColumn("credit_spread", F.col("baa") - F.col("aaa"))
    if {"gs10", "tb3ms"} <= set(paths):
        m = m.withColumn("term_spread", F.col("gs10") - F.col("tb3ms"))
    return m


#: The header spellings of a constituents file, by the role of the column; the first that is there counts.
CONSTITUENT_HEADERS = {
    "permno": ("permno", "lpermno"),
    "ticker": ("ticker", "tic", "symbol"),
    "start": ("start", "start_date", "from", "beg", "begdt"),
    "ending": ("ending", "end", "end_date", "thru", "thrudt"),
}
#: How a column of each role is read.
CONSTITUENT_TYPES = {"permno": lambda c: c.try_cast("int"), "ticker": lambda c: c, "start": parse_day, "ending": parse_day}


def constituents(spark: SparkSession, raw: RawFiles, ccm: DataFrame | None = None) -> DataFrame:
    """Membership intervals from a file by identifier or by ticker; roles without a column are null."""
    t = read_strings(spark, raw.path(spark, "constituents"))
    found = {role: first_alias(t.columns, names) for role, names in CONSTITUENT_HEADERS.items()}
    rows = t.select(*[CONSTITUENT_TYPES[role](F.col(f"`{c}`") if c else F.lit(None).cast("string")).alias(role) for role, c in found.items()])
    if not found["start"] or not (found["permno"] or found["ticker"]):
        raise ValueError("the constituents file has neither identifiers nor tickers with start dates")
    if found["permno"]:
        return clip_intervals(rows, "permno", "start", "ending", PANEL_START, PANEL_END)
    return ticker_membership(rows, merged_months(spark, raw) if ccm is None else ccm)


CONVERTERS: dict[str, Callable[[SparkSession, RawFiles], DataFrame]] = {
    "ccm_merged": merged_months, "crsp_daily": daily, "delisting": delistings, "sp500_index": index_days, "ff_factors_daily": factor_days, "ff_factors": factor_months, "fred_macro": macro_months,
    "sp500_constituents": constituents,
}


def convert_all(spark: SparkSession, raw: RawFiles, out: str) -> dict[str, str]:
    """Run every converter; the result says 'written', 'missing' or the error of each."""
    state = {}
    for name, make in CONVERTERS.items():
        try:
            t = make(spark, raw)
            write_parquet(t, f"{out}/{name}.parquet")
            logged(spark.read.parquet(f"{out}/{name}.parquet"), name, F.count(F.lit(1)).alias("rows"))
            state[name] = "written"
        except FileNotFoundError as error:
            log.warning("%s is skipped: %s", name, error)
            state[name] = "missing"
        except Exception as error:  # noqa: BLE001
            log.exception("%s failed", name)
            state[name] = f"failed: {type(error).__name__}"
    return state


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="Convert raw files to typed parquet tables.")
    p.add_argument("raw")
    p.add_argument("out")
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    for name, state in convert_all(spark, RawFiles(a.raw, RAW_NAMES), a.out).items():
        print(name, state)


if __name__ == "__main__":
    main()
