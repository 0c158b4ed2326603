"""Composite panel operators: base months, fundamentals, characteristics, universe, excess returns, ranks, macro covariates.

Each step takes and returns DataFrames, so the whole way from typed tables to the model's panel is one lazy plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelforge.functions.scalar import finite, is_finite, safe_div, safe_ln
from panelforge.operators.asof import asof_slots
from panelforge.operators.intervals import clip_intervals, membership_filter
from panelforge.operators.windows import entity_window, fill_forward_backward, full_rolling, last_row, momentum_12_1, ragged, rank_transform, with_residual_std

PANEL_START, PANEL_END = "2000-01-01", "2024-12-31"
FEATURES = ("log_mktcap", "bm", "ep", "mom_12_1", "mom_1", "roe", "roa", "asset_growth", "turnover", "idio_vol")
MACRO = ("vix", "vix_chg", "credit_spread", "term_spread")


def base_months(ccm: DataFrame, start: str = PANEL_START, end: str = PANEL_END, prefer_null_datadate: bool = False) -> DataFrame:
    """One row of each (PERMNO, month) with a finite cap and return inside the window.

    The row with the freshest datadate wins; with ``prefer_null_datadate`` one without datadate wins over all. Then the latest load and id.
    """
    rows = ccm.where(F.col("PERMNO").isNotNull() & F.col("MthCalDt").between(start, end)).where(is_finite(F.col("MthCap")) & is_finite(F.col("MthRet")))
    narrow = rows.select(
        "PERMNO", "MthCalDt", F.last_day("MthCalDt").alias("month"), F.col("MthRet").cast("double").alias("ret"), F.col("MthCap").cast("double").alias("cap"),
        F.col("MthVol").cast("double").alias("vol"), F.col("ShrOut").cast("double").alias("shares"), "datadate", "loaded_at", "rec_id",
    )
    d = F.col("datadate").desc_nulls_first() if prefer_null_datadate else F.col("datadate").desc_nulls_last()
    return last_row(narrow, ["PERMNO", "month"], d, F.col("loaded_at").desc(), F.col("rec_id").desc()).drop("datadate", "loaded_at", "rec_id")


def statements(ccm: DataFrame) -> DataFrame:
    """One statement of each (PERMNO, datadate) with total assets: the latest loaded."""
    rows = ccm.where("PERMNO IS NOT NULL AND datadate IS NOT NULL").where(is_finite(F.col("at"))).select(
        "PERMNO", "datadate", *[F.col(c).cast("double").alias(c) for c in ("at", "ceq", "ni", "ib")], "loaded_at", "rec_id"
    )
    return last_row(rows, ["PERMNO", "datadate"], F.col("loaded_at").desc(), F.col("rec_id").desc()).drop("loaded_at", "rec_id")


def with_fundamentals(base: DataFrame, stm: DataFrame, lag: int = 6, prior_lag: int = 18) -> DataFrame:
    """Statements known ``lag`` months after their period (``*_lag``) and total assets of a year before (``at_lag_prior``)."""
    names = ("at", "ceq", "ni", "ib")
    moved = stm.select("PERMNO", "datadate", *names, F.explode(F.array(F.lit(lag), F.lit(prior_lag))).alias("months"))
    # the period's end leads each struct, so the freshest statement wins among those that become available on one day
    feed = moved.select(
        "PERMNO",
        F.add_months("datadate", F.col("months")).alias("avail"),
        F.when(F.col("months") == lag, F.struct("datadate", *names)).alias("__now"),
        F.when(F.col("months") == prior_lag, F.struct("datadate", "at")).alias("__prior"),
    )
    joined = asof_slots(base, feed, "PERMNO", "MthCalDt", "avail", ["__now", "__prior"])
    return joined.select(*base.columns, *[F.col(f"__now.{c}").alias(f"{c}_lag") for c in names], F.col("__prior.at").alias("at_lag_prior"))


def with_ratios(df: DataFrame) -> DataFrame:
    """Size, value, profitability and growth; cap is in thousands and statements in millions."""
    cap_m = F.col("cap") / 1000.0
    return df.withColumns({
        "log_mktcap": safe_ln(F.col("cap")),
        "bm": safe_div(F.col("ceq_lag"), cap_m),
        "ep": safe_div(F.col("ib_lag"), cap_m),
        "roe": safe_div(F.col("ni_lag"), F.col("ceq_lag")),
        "roa": safe_div(F.col("ni_lag"), F.col("at_lag")),
        "asset_growth": safe_div(F.col("at_lag"), F.col("at_lag_prior")) - 1,
    })


def with_momentum(df: DataFrame) -> DataFrame:
    w = entity_window("PERMNO", "month")
    return df.withColumns({"mom_12_1": momentum_12_1(F.col("ret"), w), "mom_1": F.lag("ret").over(w)})


def with_turnover(df: DataFrame) -> DataFrame:
    """Volume over shares; shares are in thousands."""
    return df.withColumn("turnover", F.when(F.col("shares") > 0, F.col("vol") / (F.col("shares") * 1000.0)))


def daily_returns(crsp: DataFrame, start: str = "1999-01-01") -> DataFrame:
    """One return of each (PERMNO, day): the latest loaded finite one, folded map-side so that a hot PERMNO shrinks to its days."""
    rows = crsp.where(F.col("PERMNO").isNotNull() & (F.col("date") >= start)).select("PERMNO", "date", finite(F.col("RET")).alias("v"), F.struct("loaded_at", "rec_id").alias("o"))
    return rows.where("v IS NOT NULL").groupBy("PERMNO", "date").agg(F.max_by("v", "o").alias("ret"))


def market_returns(index: DataFrame, column: str = "sprtrn") -> DataFrame:
    return index.groupBy(F.col("caldt").alias("date")).agg(F.max(finite(F.col(column))).alias("mkt")).where("mkt IS NOT NULL")


def volatility_proxy(index: DataFrame, column: str = "sprtrn") -> DataFrame:
    """Each month's deviation of the last three monthly index returns, filled at the ends: month, r, vol."""
    m = market_returns(index, column).groupBy(F.last_day("date").alias("month")).agg((F.exp(F.sum(F.log1p("mkt"))) - 1).alias("r"))
    w = Window.orderBy("month")  # a monthly series: a few hundred rows
    return m.withColumn("sd", full_rolling(F.stddev_samp("r"), F.col("r"), w, -2, 0)).select("month", "r", fill_forward_backward(F.col("sd"), w).alias("vol"))


def idio_vol(daily: DataFrame, market: DataFrame, rows: int = 60, least: int = 30) -> DataFrame:
    """Residual deviation of the last ``rows`` daily rows on the market, at the last row of each (PERMNO, month).

    ``market``: date, mkt and, for excess returns, rf. Days without a market figure are left out.
    """
    joined = daily.join(F.broadcast(market), "date")  # one row a trading day
    if "rf" in market.columns:
        joined = joined.withColumn("ret", F.col("ret") - F.col("rf"))
    w = entity_window("PERMNO", "date")
    vol = with_residual_std(joined, "PERMNO", "date", "ret", "mkt", "idio_vol", rows, least).withColumn("nxt", F.lead("date").over(w))
    last = vol.where(F.col("nxt").isNull() | (F.last_day("nxt") != F.last_day("date")))
    return last.where("idio_vol IS NOT NULL").select("PERMNO", F.last_day("date").alias("month"), "idio_vol")


def characteristics(ccm: DataFrame, crsp: DataFrame, index: DataFrame) -> DataFrame:
    """The long panel: (PERMNO, MthCalDt, ret, ten features)."""
    panel = with_turnover(with_momentum(with_ratios(with_fundamentals(base_months(ccm), statements(ccm)))))
    vol = idio_vol(daily_returns(crsp), market_returns(index))
    return panel.join(vol, ["PERMNO", "month"], "left").select("PERMNO", "MthCalDt", "month", "ret", *FEATURES)


def members(constituents: DataFrame) -> DataFrame:
    """Memberships within the panel's window; an open one lasts to its end."""
    return clip_intervals(constituents, "permno", "start", "ending", PANEL_START, PANEL_END)


def universe(panel: DataFrame, constituents: DataFrame) -> DataFrame:
    return membership_filter(panel, constituents, "PERMNO", "MthCalDt", "permno", "start", "ending")


def with_excess(panel: DataFrame, rf: DataFrame) -> DataFrame:
    """Return minus the month's risk-free rate (columns month, rf); null where the month has none."""
    return panel.join(F.broadcast(rf.select("month", "rf")), "month", "left").withColumn("ex_ret", F.col("ret") - F.col("rf")).drop("rf")


def delisting_returns(delisting: DataFrame) -> DataFrame:
    """One delisting return of each (PERMNO, month): the reported one, else -0.30 for codes 400..599, else 0; the latest load wins."""
    rows = delisting.where("PERMNO IS NOT NULL AND DLSTDT IS NOT NULL").select("PERMNO", F.last_day("DLSTDT").alias("month"), finite(F.col("DLRET")).alias("r"), F.col("DLSTCD").alias("code"), "loaded_at", "rec_id")
    one = last_row(rows, ["PERMNO", "month"], F.col("r").isNull(), F.col("loaded_at").desc(), F.col("rec_id").desc())
    dl = F.when(F.col("r").isNotNull(), F.col("r")).when((F.col("code") >= 400) & (F.col("code") < 600), F.lit(-0.30)).when(F.col("code").isNotNull(), F.lit(0.0))
    return one.select("PERMNO", "month", dl.alias("dl"))


def with_delisting(panel: DataFrame, dl: DataFrame, ret: str = "ex_ret") -> DataFrame:
    """Returns compounded with the delisting return of their month; other months as they were."""
    joined = panel.join(dl, ["PERMNO", "month"], "left")
    return joined.withColumn(ret, F.when(F.col("dl").isNotNull(), (1 + F.coalesce(ret, F.lit(0.0))) * (1 + F.col("dl")) - 1).otherwise(F.col(ret))).drop("dl")


def ranked(panel: DataFrame, features: tuple[str, ...] = FEATURES) -> DataFrame:
    return rank_transform(panel, "month", "PERMNO", list(features))


def model_panel(panel: DataFrame, constituents: DataFrame, rf: DataFrame, dl: DataFrame, least: int = 30) -> DataFrame:
    """Universe, excess returns, delisting, ranks over all rows, then only finite returns, and one row a month with arrays."""
    rows = ranked(with_delisting(with_excess(universe(panel, constituents), rf), dl))
    return ragged(rows.where(is_finite(F.col("ex_ret"))), "month", "PERMNO", "ex_ret", list(FEATURES), least)


def lagged_macro(macro: DataFrame, dates: DataFrame, columns: tuple[str, ...] = MACRO) -> DataFrame:
    """Each panel month with the macro figures of the month before; columns that are missing are left out."""
    present = [c for c in columns if c in macro.columns]
    w = Window.orderBy("month")  # a monthly series: a few hundred rows
    lags = macro.select("month", *[F.lag(c).over(w).alias(f"{c}_lag1") for c in present])
    return dates.join(lags, "month", "left")


def aligned_panel(ragged_panel: DataFrame, z: DataFrame, columns: list[str]) -> DataFrame:
    """Ragged months with a complete vector of covariates beside them."""
    vec = F.array(*[F.col(c) for c in columns])
    return ragged_panel.join(z.na.drop(subset=columns).select("month", vec.alias("z")), "month")


def ticker_membership(members: DataFrame, ccm: DataFrame, start: str = PANEL_START, end: str = PANEL_END) -> DataFrame:
    """Memberships given by ticker as intervals of PERMNO: expand to months, match (ticker, month), join successive months again."""
    hi = F.lit(end).cast("date")
    m = members.select(F.upper(F.trim("ticker")).alias("ticker"), F.greatest("start", F.lit(start).cast("date")).alias("s"), F.least(F.coalesce("ending", hi), hi).alias("e"))
    months = m.where("ticker IS NOT NULL AND s IS NOT NULL AND e >= s").select("ticker", F.explode(F.sequence(F.trunc("s", "MM"), F.trunc("e", "MM"), F.expr("interval 1 month"))).alias("m")).distinct()
    rows = ccm.where(F.col("MthCalDt").between(start, end) & F.col("Ticker").isNotNull() & F.col("PERMNO").isNotNull())
    held = rows.select("PERMNO", "MthCalDt", F.upper(F.trim("Ticker")).alias("ticker"), F.trunc("MthCalDt", "MM").alias("m")).distinct()
    hit = held.join(months, ["ticker", "m"]).select("PERMNO", "MthCalDt").distinct()
    w = Window.partitionBy("PERMNO").orderBy("MthCalDt")
    ym: Column = F.year("MthCalDt") * 12 + F.month("MthCalDt")
    seg = hit.withColumn("ym", ym).withColumn("fresh", F.coalesce(F.col("ym") - F.lag("ym").over(w) != 1, F.lit(True)).cast("int"))
    runs = seg.withColumn("segment", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("PERMNO", "segment").agg(F.min("MthCalDt").alias("start"), F.max("MthCalDt").alias("ending")).select(F.col("PERMNO").alias("permno"), "start", "ending")
