"""Queries on projections, casts, joins, aggregates, windows and reshaping, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from panelforge.functions.scalar import finite, is_finite, month_ordinal, null_tokens, parse_day
from panelforge.operators import intervals, joins, sampling, windows
from panelforge.operators.quantiles import exact_quantiles
from panelforge.plans import panel, prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(c: Column | str, n: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, n)


def day(c: str) -> Column:
    return F.col(c).cast("date")


# --- projections, casts, filters ---------------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_extendedprice * (1 - l_discount) AS net, l_shipdate::DATE AS ship FROM lineitem WHERE l_shipdate BETWEEN DATE '1996-01-01' AND DATE '1996-12-31' AND l_quantity IS NOT NULL AND l_quantity > 10")
def scan_project_filter(spark, d):
    t = table(spark, d, "lineitem").where(F.col("l_shipdate").between("1996-01-01", "1996-12-31") & F.col("l_quantity").isNotNull() & (F.col("l_quantity") > 10))
    return t.select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"), day("l_shipdate").alias("ship"))


@query("""SELECT o_orderkey, coalesce(try_strptime(s, '%Y-%m-%d'), try_strptime(s, '%Y%m%d'))::DATE AS parsed FROM (SELECT o_orderkey,
  CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y%m%d') ELSE 'n/a ' || o_orderstatus END s FROM orders)""")
def date_parse_dual_format(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey") % 3
    s = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 1, F.date_format("o_orderdate", "yyyyMMdd")).otherwise(F.concat(F.lit("n/a "), F.col("o_orderstatus")))
    return o.select("o_orderkey", parse_day(s).alias("parsed"))


@query("""SELECT event_type, count(*)::BIGINT n, count(TRY_CAST(s AS INTEGER))::BIGINT n_int, count(TRY_CAST(s AS DOUBLE))::BIGINT n_double, sum(TRY_CAST(s AS INTEGER))::BIGINT total FROM
  (SELECT event_type, CASE WHEN event_id % 5 = 0 THEN 'x' || event_id ELSE event_id::VARCHAR END s FROM events) GROUP BY 1""")
def noncast_try_cast(spark, d):
    e = table(spark, d, "events")
    s = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("x"), F.col("event_id").cast("string"))).otherwise(F.col("event_id").cast("string"))
    t = e.select("event_type", s.alias("s")).select("event_type", F.col("s").try_cast("int").alias("i"), F.col("s").try_cast("double").alias("x"))
    return t.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count("i").alias("n_int"), F.count("x").alias("n_double"), F.sum(F.col("i").cast("long")).alias("total"))


@query("SELECT PERMNO, count(*)::BIGINT n, count(CASE WHEN gsector NOT IN ('', 'NA', 'n/a', 'NaN') THEN gsector END)::BIGINT n_known FROM char_panel_raw GROUP BY 1")
def null_token_normalise(spark, d):
    t = table(spark, d, "char_panel_raw").select("PERMNO", null_tokens(F.col("gsector"), ("", "NA", "n/a", "NaN")).alias("s"))
    return t.groupBy("PERMNO").agg(F.count(F.lit(1)).alias("n"), F.count("s").alias("n_known"))


@query("""SELECT o_orderkey, (dt + INTERVAL 6 MONTH)::DATE plus_6, (dt + INTERVAL 18 MONTH)::DATE plus_18, last_day(dt) month_end, date_trunc('month', dt)::DATE month_start,
  (year(dt) * 12 + month(dt))::INTEGER ordinal FROM (SELECT o_orderkey, o_orderdate::DATE dt FROM orders)""")
def month_offset_end(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", day("o_orderdate").alias("dt"))
    return o.select("o_orderkey", F.add_months("dt", 6).alias("plus_6"), F.add_months("dt", 18).alias("plus_18"), F.last_day("dt").alias("month_end"), F.trunc("dt", "MM").alias("month_start"), month_ordinal(F.col("dt")).alias("ordinal"))


@query("SELECT d, count(*)::BIGINT n FROM (SELECT DISTINCT PERMNO, DLSTDT d FROM delisting WHERE PERMNO IS NOT NULL AND DLSTDT IS NOT NULL) GROUP BY 1")
def distinct_rows(spark, d):
    t = table(spark, d, "delisting").na.drop(subset=["PERMNO", "DLSTDT"]).select("PERMNO", F.col("DLSTDT").alias("d")).distinct()
    return t.groupBy("d").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT upper(trim(Ticker)) ticker, count(*)::BIGINT n, count(DISTINCT PERMNO)::BIGINT n_permno FROM ccm_merged WHERE Ticker IS NOT NULL GROUP BY 1")
def ticker_normalise(spark, d):
    t = table(spark, d, "ccm_merged").where("Ticker IS NOT NULL").select(F.upper(F.trim("Ticker")).alias("ticker"), "PERMNO")
    return t.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("PERMNO").alias("n_permno"))


# --- aggregates --------------------------------------------------------------------------------------------------------------


@query("""SELECT PERMNO, count(*)::BIGINT n, count(*) FILTER (WHERE RET IS NULL)::BIGINT n_null, count(*) FILTER (WHERE NOT coalesce(isfinite(RET), false))::BIGINT n_bad,
  round(avg(RET::DOUBLE) FILTER (WHERE isfinite(RET)), 6) mean, round(stddev_samp(RET::DOUBLE) FILTER (WHERE isfinite(RET)), 6) sd,
  round(min(RET::DOUBLE) FILTER (WHERE isfinite(RET)), 6) lo, round(max(RET::DOUBLE) FILTER (WHERE isfinite(RET)), 6) hi FROM crsp_daily GROUP BY 1""")
def null_finite_profile(spark, d):
    t = table(spark, d, "crsp_daily").select("PERMNO", "RET", finite(F.col("RET")).alias("v"))
    return t.groupBy("PERMNO").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("RET").isNull()).alias("n_null"), F.count_if(F.col("v").isNull()).alias("n_bad"), r(F.avg("v")).alias("mean"), r(F.stddev_samp("v")).alias("sd"), r(F.min("v")).alias("lo"), r(F.max("v")).alias("hi"))


@query("""SELECT l_returnflag, l_linestatus, round(quantile_cont(l_extendedprice, 0.01), 4) p01, round(quantile_cont(l_extendedprice, 0.5), 4) p50, round(quantile_cont(l_extendedprice, 0.99), 4) p99,
  round(median(l_quantity), 4) med_qty FROM lineitem GROUP BY 1, 2""")
def char_quantiles(spark, d):
    t, keys = table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"]
    price, qty = exact_quantiles(t, keys, "l_extendedprice", (0.01, 0.5, 0.99)), exact_quantiles(t, keys, "l_quantity", (0.5,), "m")
    g = price.join(qty, keys)
    return g.select(*keys, r(F.col("q")[0], 4).alias("p01"), r(F.col("q")[1], 4).alias("p50"), r(F.col("q")[2], 4).alias("p99"), r(F.col("m")[0], 4).alias("med_qty"))


@query("""SELECT src, count(*) FILTER (WHERE DLSTCD BETWEEN 100 AND 199)::BIGINT active, count(*) FILTER (WHERE DLSTCD BETWEEN 200 AND 399)::BIGINT merged, count(*) FILTER (WHERE DLSTCD BETWEEN 400 AND 599)::BIGINT failed,
  count(*) FILTER (WHERE DLSTCD IS NULL)::BIGINT unknown, count(*) FILTER (WHERE DLRET < -1 OR DLRET > 5)::BIGINT odd FROM delisting GROUP BY 1""")
def bucketed_counts(spark, d):
    c, x = F.col("DLSTCD"), finite(F.col("DLRET"))
    return table(spark, d, "delisting").groupBy("src").agg(F.count_if(c.between(100, 199)).alias("active"), F.count_if(c.between(200, 399)).alias("merged"), F.count_if(c.between(400, 599)).alias("failed"), F.count_if(c.isNull()).alias("unknown"), F.count_if((x < -1) | (x > 5)).alias("odd"))


@query("SELECT o_orderpriority, count(DISTINCT o_custkey)::BIGINT n_cust, count(DISTINCT o_orderdate::DATE)::BIGINT n_days FROM orders GROUP BY 1")
def count_distinct_profile(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count_distinct("o_custkey").alias("n_cust"), F.count_distinct(day("o_orderdate")).alias("n_days"))


@query("SELECT y, round(median(n), 4) median_days, min(n)::BIGINT least, max(n)::BIGINT most FROM (SELECT PERMNO, year(date)::INTEGER y, count(DISTINCT date) n FROM crsp_daily WHERE PERMNO IS NOT NULL AND date IS NOT NULL GROUP BY 1, 2) GROUP BY 1")
def median_rows_per_entity_year(spark, d):
    days = table(spark, d, "crsp_daily").where("PERMNO IS NOT NULL AND date IS NOT NULL").select("PERMNO", "date").distinct()
    n = days.groupBy("PERMNO", F.year("date").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("y").agg(r(F.median("n"), 4).alias("median_days"), F.min("n").alias("least"), F.max("n").alias("most"))


BASE = """base AS (SELECT PERMNO, MthCalDt, last_day(MthCalDt) AS mon, MthRet::DOUBLE ret, MthCap::DOUBLE cap, MthVol::DOUBLE vol, ShrOut::DOUBLE shares FROM (SELECT *, row_number() OVER
  (PARTITION BY PERMNO, last_day(MthCalDt) ORDER BY datadate DESC NULLS LAST, loaded_at DESC, rec_id DESC) rn FROM ccm_merged WHERE PERMNO IS NOT NULL AND MthCalDt BETWEEN DATE '2000-01-01' AND DATE '2024-12-31'
  AND coalesce(isfinite(MthCap), false) AND coalesce(isfinite(MthRet), false)) WHERE rn = 1)"""


def _base(spark, d):
    return panel.base_months(table(spark, d, "ccm_merged"))


@query(f"WITH {BASE} SELECT PERMNO, MthCalDt, mon AS month, round(ret, 6) ret, round(cap, 2) cap, vol, shares FROM base")
def dedupe_last_row(spark, d):
    return _base(spark, d).select("PERMNO", "MthCalDt", "month", r("ret").alias("ret"), r("cap", 2).alias("cap"), "vol", "shares")


@query("SELECT permno, start, ending FROM (SELECT *, row_number() OVER (PARTITION BY permno ORDER BY start, ending NULLS LAST) n FROM sp500_constituents WHERE permno IS NOT NULL AND start IS NOT NULL) WHERE n = 1")
def dedupe_keep_first(spark, d):
    t = table(spark, d, "sp500_constituents").na.drop(subset=["permno", "start"])
    return windows.last_row(t, ["permno"], F.col("start"), F.col("ending").asc_nulls_last())


#: The daily factors as they are called here and in the table.
FACTOR_COLUMNS = {"mkt": "mkt_rf", "smb": "smb", "hml": "hml", "rmw": "rmw", "cma": "cma", "rf": "rf"}
# every day's factors as fractions: the median of the sources' last figures
FACD = f"""{prepare.units_sql(("ff_factors_daily",))},
fz AS (SELECT date, src, f, arg_max(v * power(10, -coalesce(step, 0)), {{'l': loaded_at, 'r': row_id}}) x FROM fu GROUP BY ALL),
facd AS (SELECT d.date, {", ".join(f"median(x) FILTER (WHERE f = '{c}') {f}" for f, c in FACTOR_COLUMNS.items())} FROM (SELECT DISTINCT date FROM ff_factors_daily WHERE date IS NOT NULL) d LEFT JOIN fz USING (date) GROUP BY 1)"""


def daily_factors(spark, d):
    """The daily factors as fractions from all sources and units, each figure by itself: every day of the table, null only where no source has the figure."""
    return prepare.factor_series(spark, d, "ff_factors_daily", ["mkt_rf", "smb", "hml", "rmw", "cma", "rf"]).withColumnRenamed("mkt_rf", "mkt")


def _months_sql(columns: list[str]) -> str:
    return ", ".join(f"CASE WHEN count({c}) = count(*) THEN product(1 + {c}) - 1 END {c}" for c in columns)


def compounded(daily: DataFrame, columns: list[str]) -> DataFrame:
    """Months of daily returns; a null day makes its month null."""
    return daily.groupBy(F.last_day("date").alias("month")).agg(*[F.when(F.count(c) == F.count(F.lit(1)), F.product(1 + F.col(c)) - 1).alias(c) for c in columns])


@query(f"WITH {FACD} SELECT c.date, count(*)::BIGINT n, round(avg(c.RET::DOUBLE - f.rf), 6) mean_excess, round(max(f.mkt), 6) mkt FROM crsp_daily c JOIN facd f ON c.date = f.date WHERE isfinite(c.RET) AND c.RET > -1 AND c.RET < 1 GROUP BY 1")
def inner_join_factors(spark, d):
    c = table(spark, d, "crsp_daily").select("date", finite(F.col("RET")).alias("ret")).where("ret > -1 AND ret < 1")
    j = c.join(joins.small(daily_factors(spark, d)), "date")
    return j.groupBy("date").agg(F.count(F.lit(1)).alias("n"), r(F.avg(F.col("ret") - F.col("rf"))).alias("mean_excess"), r(F.max("mkt")).alias("mkt"))


@query("""WITH m AS (SELECT last_day(o_orderdate::DATE) me, sum(o_totalprice) total FROM orders WHERE year(o_orderdate) >= 1996 GROUP BY 1)
SELECT l.o_orderkey, round(m.total, 2) month_total FROM orders l LEFT JOIN m ON last_day(l.o_orderdate::DATE) = m.me""")
def left_join_month_end(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", day("o_orderdate").alias("dt"), "o_totalprice")
    m = o.where(F.year("dt") >= 1996).groupBy(F.last_day("dt").alias("dt")).agg(F.sum("o_totalprice").alias("total"))
    return joins.month_end_join(o, m, "dt", "dt", ["total"]).select("o_orderkey", r("total", 2).alias("month_total"))


def _monthly_source(spark, d, src):
    t = table(spark, d, "ff_factors").where((F.col("src") == src) & is_finite(F.col("smb")) & F.col("date").isNotNull())
    return windows.last_row(t, ["date"], F.col("row_id")).select("date", F.col("smb").cast("double").alias("smb"), finite(F.col("hml")).alias("hml"))


@query("""WITH a AS (SELECT date, smb::DOUBLE smb, CASE WHEN isfinite(hml) THEN hml::DOUBLE END hml FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY row_id) n FROM ff_factors WHERE src = 'factor_library' AND isfinite(smb) AND date IS NOT NULL) WHERE n = 1),
b AS (SELECT date, smb::DOUBLE smb, CASE WHEN isfinite(hml) THEN hml::DOUBLE END hml FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY row_id) n FROM ff_factors WHERE src = 'pull_00_001' AND isfinite(smb) AND date IS NOT NULL) WHERE n = 1)
SELECT coalesce(a.date, b.date) date, round(coalesce(b.smb, a.smb), 6) smb, round(coalesce(b.hml, a.hml), 6) hml FROM a FULL OUTER JOIN b ON a.date = b.date""")
def full_outer_override(spark, d):
    return joins.override(_monthly_source(spark, d, "factor_library"), _monthly_source(spark, d, "pull_00_001"), ["date"], ["smb", "hml"]).select("date", r("smb").alias("smb"), r("hml").alias("hml"))


@query("""SELECT 'shared' kind, count(*)::BIGINT n FROM (SELECT PERMNO FROM ccm_merged INTERSECT SELECT PERMNO FROM crsp_daily) WHERE PERMNO IS NOT NULL
UNION ALL SELECT 'semi', count(*) FROM ccm_merged c WHERE EXISTS (SELECT 1 FROM delisting d WHERE d.PERMNO = c.PERMNO)
UNION ALL SELECT 'anti', count(*) FROM ccm_merged c WHERE NOT EXISTS (SELECT 1 FROM delisting d WHERE d.PERMNO = c.PERMNO)""")
def semi_overlap(spark, d):
    c, x, k = table(spark, d, "ccm_merged").select("PERMNO"), table(spark, d, "crsp_daily").select("PERMNO"), table(spark, d, "delisting").select("PERMNO")
    row = lambda kind, t: t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
    return row("shared", joins.shared_ids(c, x, "PERMNO", "PERMNO").where("id IS NOT NULL")).unionByName(row("semi", c.join(k, "PERMNO", "left_semi"))).unionByName(row("anti", c.join(k, "PERMNO", "left_anti")))


STM = """stm AS (SELECT PERMNO, datadate, "at"::DOUBLE a, CASE WHEN isfinite(ceq) THEN ceq::DOUBLE WHEN isnan(ceq) THEN 'nan'::DOUBLE END c, ni::DOUBLE n, ib::DOUBLE i FROM (SELECT *, row_number() OVER (PARTITION BY PERMNO, datadate ORDER BY loaded_at DESC, rec_id DESC) rn
  FROM ccm_merged WHERE PERMNO IS NOT NULL AND datadate IS NOT NULL AND coalesce(isfinite("at"), false)) WHERE rn = 1),
s6 AS (SELECT PERMNO, (datadate + INTERVAL 6 MONTH)::DATE avail, arg_max({'a': a, 'c': c, 'n': n, 'i': i}, datadate) s FROM stm GROUP BY 1, 2),
s18 AS (SELECT PERMNO, (datadate + INTERVAL 18 MONTH)::DATE avail, arg_max({'a': a}, datadate) s FROM stm GROUP BY 1, 2)"""
FUND = f"""{BASE}, {STM}, fund AS (SELECT b.*, s6.s.a at_lag, s6.s.c ceq_lag, s6.s.n ni_lag, s6.s.i ib_lag, s18.s.a at_lag_prior FROM base b
  ASOF LEFT JOIN s6 ON b.PERMNO = s6.PERMNO AND b.MthCalDt >= s6.avail ASOF LEFT JOIN s18 ON b.PERMNO = s18.PERMNO AND b.MthCalDt >= s18.avail)"""


def _fund(spark, d):
    ccm = table(spark, d, "ccm_merged")
    return panel.with_fundamentals(panel.base_months(ccm), panel.statements(ccm))


@query(f"WITH {FUND} SELECT PERMNO, MthCalDt, round(at_lag, 4) at_lag, round(ceq_lag, 4) ceq_lag, round(ni_lag, 4) ni_lag, round(ib_lag, 4) ib_lag, round(at_lag_prior, 4) at_lag_prior FROM fund")
def asof_fundamentals_lag(spark, d):
    return _fund(spark, d).select("PERMNO", "MthCalDt", *[r(c, 4).alias(c) for c in ("at_lag", "ceq_lag", "ni_lag", "ib_lag", "at_lag_prior")])


@query(f"""WITH {FUND} SELECT PERMNO, MthCalDt, round(CASE WHEN cap > 0 THEN ln(cap) END, 6) log_mktcap, round(ceq_lag / nullif(cap / 1000, 0), 6) bm, round(ib_lag / nullif(cap / 1000, 0), 6) ep, round(ni_lag / nullif(ceq_lag, 0), 6) roe,
  round(ni_lag / nullif(at_lag, 0), 6) roa, round(at_lag / nullif(at_lag_prior, 0) - 1, 6) asset_growth FROM fund""")
def valuation_ratios(spark, d):
    return panel.with_ratios(_fund(spark, d)).select("PERMNO", "MthCalDt", *[r(c).alias(c) for c in ("log_mktcap", "bm", "ep", "roe", "roa", "asset_growth")])


@query(f"""WITH {BASE}, m AS (SELECT PERMNO, mon, lag(ret) OVER w m1, count(*) OVER f k, sum(CASE WHEN ret > -1 THEN ln(1 + ret) ELSE 0 END) OVER f s, min(ret) OVER f mn FROM base WINDOW w AS (PARTITION BY PERMNO ORDER BY mon),
  f AS (PARTITION BY PERMNO ORDER BY mon ROWS BETWEEN 12 PRECEDING AND 2 PRECEDING)) SELECT PERMNO, mon AS month, round(CASE WHEN k = 11 AND mn > -1 THEN exp(s) - 1 WHEN k = 11 AND mn = -1 THEN -1 END, 6) mom_12_1, round(m1, 6) mom_1 FROM m""")
def lag_momentum(spark, d):
    return panel.with_momentum(_base(spark, d)).select("PERMNO", "month", r("mom_12_1").alias("mom_12_1"), r("mom_1").alias("mom_1"))


@query(f"WITH {BASE} SELECT PERMNO, mon AS month, CASE WHEN shares > 0 THEN vol / (shares * 1000) END turnover FROM base")
def turnover_ratio(spark, d):
    return panel.with_turnover(_base(spark, d)).select("PERMNO", "month", "turnover")


IDXD = "idxd AS (SELECT caldt d, max(sprtrn::DOUBLE) r FROM sp500_index WHERE isfinite(sprtrn) GROUP BY 1)"
IDXM = f"{IDXD}, idxm AS (SELECT last_day(d) AS m, exp(sum(ln(1 + r))) - 1 r FROM idxd GROUP BY 1), vol3 AS (SELECT m, r, CASE WHEN count(r) OVER w = 3 THEN stddev_samp(r) OVER w END sd FROM idxm WINDOW w AS (ORDER BY m ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))"


def monthly_index(spark, d):
    """Monthly index return and its three-month rolling deviation."""
    idx = panel.market_returns(table(spark, d, "sp500_index"))
    m = idx.groupBy(F.last_day("date").alias("month")).agg((F.exp(F.sum(F.log1p("mkt"))) - 1).alias("r"))
    w = Window.orderBy("month")  # a few hundred months
    return m.withColumn("sd", windows.full_rolling(F.stddev_samp("r"), F.col("r"), w, -2, 0))


@query(f"WITH {IDXM} SELECT m AS month, round(r, 6) r, round(sd, 6) sd FROM vol3")
def rolling_std3(spark, d):
    return monthly_index(spark, d).select("month", r("r").alias("r"), r("sd").alias("sd"))


@query(f"WITH {IDXM} SELECT m AS month, round(coalesce(last_value(sd IGNORE NULLS) OVER (ORDER BY m), first_value(sd IGNORE NULLS) OVER (ORDER BY m ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) sd FROM vol3")
def ffill_bfill(spark, d):
    return monthly_index(spark, d).select("month", r(windows.fill_forward_backward(F.col("sd"), Window.orderBy("month"))).alias("sd"))


DAILY = """dly AS (SELECT PERMNO, date, arg_max(RET::DOUBLE, {'l': loaded_at, 'r': rec_id}) ret FROM crsp_daily WHERE PERMNO IS NOT NULL AND date >= DATE '1999-01-01' AND isfinite(RET) GROUP BY 1, 2)"""
IVOL = f"""{IDXD}, {DAILY}, jd AS (SELECT PERMNO, date, ret y, idxd.r x FROM dly JOIN idxd ON date = idxd.d),
rv AS (SELECT PERMNO, date, count(*) OVER w n, regr_sxx(y, x) OVER w sxx, regr_syy(y, x) OVER w syy, regr_sxy(y, x) OVER w sxy, lead(date) OVER (PARTITION BY PERMNO ORDER BY date) nx FROM jd WINDOW w AS (PARTITION BY PERMNO ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
ivol AS (SELECT PERMNO, last_day(date) mon, sqrt(greatest(CASE WHEN sxx > 0 THEN syy - sxy * sxy / sxx ELSE syy END, 0) / (n - 2)) * sqrt(21) idio_vol FROM rv WHERE n >= 30 AND (nx IS NULL OR last_day(nx) <> last_day(date)))"""


def _ivol(spark, d):
    return panel.idio_vol(panel.daily_returns(table(spark, d, "crsp_daily")), panel.market_returns(table(spark, d, "sp500_index")))


@query(f"WITH {IVOL} SELECT PERMNO, mon AS month, round(idio_vol, 5) idio_vol FROM ivol")
def idio_vol_60(spark, d):
    return _ivol(spark, d).select("PERMNO", "month", r("idio_vol", 5).alias("idio_vol"))


@query(f"""WITH {FACD}, {DAILY}, jd AS (SELECT PERMNO, dly.date, ret - rf y, mkt x FROM dly JOIN facd ON facd.date = dly.date WHERE mkt IS NOT NULL AND rf IS NOT NULL),
rv AS (SELECT PERMNO, date, count(*) OVER w n, regr_sxx(y, x) OVER w sxx, regr_syy(y, x) OVER w syy, regr_sxy(y, x) OVER w sxy, lead(date) OVER (PARTITION BY PERMNO ORDER BY date) nx FROM jd WINDOW w AS (PARTITION BY PERMNO ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))
SELECT PERMNO, last_day(date) AS month, round(sqrt(greatest(CASE WHEN sxx > 0 THEN syy - sxy * sxy / sxx ELSE syy END, 0) / (n - 2)) * sqrt(21), 5) idio_vol FROM rv WHERE n >= 30 AND (nx IS NULL OR last_day(nx) <> last_day(date))""")
def idio_vol_excess(spark, d):
    """Excess returns on the market factor, as the published characteristic has it."""
    market = daily_factors(spark, d).select("date", "mkt", "rf").na.drop()
    v = panel.idio_vol(panel.daily_returns(table(spark, d, "crsp_daily")), market)
    return v.select("PERMNO", "month", r("idio_vol", 5).alias("idio_vol"))


def _rank_sql(c: str) -> str:
    ok = f"coalesce(isfinite({c}), false)"
    return f"CASE WHEN NOT {ok} OR sum({ok}::INT) OVER (PARTITION BY mon) <= 1 THEN 0.0 ELSE (row_number() OVER (PARTITION BY mon ORDER BY {ok} DESC, {c}, PERMNO) - 1) / (sum({ok}::INT) OVER (PARTITION BY mon) - 1)::DOUBLE - 0.5 END"


@query(f"WITH {BASE} SELECT PERMNO, mon AS month, round({_rank_sql('ret')}, 6) ret, round({_rank_sql('vol')}, 6) vol FROM base")
def rank_transform(spark, d):
    return windows.rank_transform(_base(spark, d), "month", "PERMNO", ["ret", "vol"]).select("PERMNO", "month", r("ret").alias("ret"), r("vol").alias("vol"))


MACRO_ORDERS = "mo AS (SELECT last_day(o_orderdate::DATE) mon, avg((o_orderpriority = '1-URGENT')::INT) a, avg((o_orderstatus = 'F')::INT) b FROM orders GROUP BY 1)"


@query(f"""WITH {FACD}, fm AS (SELECT last_day(date) mon, {_months_sql(["mkt", "rf"])} FROM facd GROUP BY 1),
sp AS (SELECT last_day(unnest(generate_series((SELECT date_trunc('month', min(mon)) FROM fm), (SELECT date_trunc('month', max(mon)) FROM fm), INTERVAL 1 MONTH))::DATE) mon)
SELECT sp.mon AS month, CASE WHEN fm.mon IS NULL THEN 0 ELSE round(mkt, 6) END mkt, CASE WHEN fm.mon IS NULL THEN 0 ELSE round(rf, 6) END rf FROM sp LEFT JOIN fm ON fm.mon = sp.mon""")
def compounded_monthly_factor(spark, d):
    return windows.compound_months(daily_factors(spark, d), "date", ["mkt", "rf"]).select("month", r("mkt").alias("mkt"), r("rf").alias("rf"))


@query("""WITH v AS (SELECT caldt d, max(vwretd::DOUBLE) FILTER (WHERE isfinite(vwretd)) a, max(totcnt) b FROM sp500_index GROUP BY 1),
m AS (SELECT last_day(d) mon, arg_max(a, d) FILTER (WHERE a IS NOT NULL) a, arg_max(b, d) FILTER (WHERE b IS NOT NULL) b FROM v GROUP BY 1)
SELECT mon AS month, round(a, 6) vwretd, b totcnt, round(a - lag(a) OVER (ORDER BY mon), 6) chg FROM m""")
def month_last_resample(spark, d):
    t = table(spark, d, "sp500_index").groupBy(F.col("caldt").alias("d")).agg(F.max(finite(F.col("vwretd"))).alias("vwretd"), F.max("totcnt").alias("totcnt"))
    m = windows.resample_last(t, "d", ["vwretd", "totcnt"])
    w = Window.orderBy("month")
    return m.select("month", r("vwretd").alias("vwretd"), "totcnt", r(windows.first_difference(F.col("vwretd"), w)).alias("chg"))


@query(f"""WITH {MACRO_ORDERS}, z AS (SELECT mon, lag(a) OVER (ORDER BY mon) vix_lag1, lag(b) OVER (ORDER BY mon) term_spread_lag1 FROM mo),
dts AS (SELECT DISTINCT last_day(l_shipdate::DATE) mon FROM lineitem) SELECT dts.mon AS month, round(vix_lag1, 6) vix_lag1, round(term_spread_lag1, 6) term_spread_lag1 FROM dts LEFT JOIN z USING (mon)""")
def macro_lag_align(spark, d):
    o = table(spark, d, "orders").groupBy(F.last_day(day("o_orderdate")).alias("month")).agg(F.avg((F.col("o_orderpriority") == "1-URGENT").cast("int")).alias("vix"), F.avg((F.col("o_orderstatus") == "F").cast("int")).alias("term_spread"))
    dates = table(spark, d, "lineitem").select(F.last_day(day("l_shipdate")).alias("month")).distinct()
    return panel.lagged_macro(o, dates).select("month", r("vix_lag1").alias("vix_lag1"), r("term_spread_lag1").alias("term_spread_lag1"))


def constituents(spark, d):
    return table(spark, d, "sp500_constituents")


def members(spark, d):
    """The constituents with open memberships up to the panel's end."""
    return panel.members(constituents(spark, d))


# --- intervals, membership ---------------------------------------------------------------------------------------------------


#: Memberships within the panel's window; a null end lasts to its end.
IV = f"""iv AS (SELECT DISTINCT permno, greatest(start, DATE '{panel.PANEL_START}') AS start, least(coalesce(ending, DATE '{panel.PANEL_END}'), DATE '{panel.PANEL_END}') ending FROM sp500_constituents WHERE permno IS NOT NULL AND start IS NOT NULL
  AND greatest(start, DATE '{panel.PANEL_START}') <= least(coalesce(ending, DATE '{panel.PANEL_END}'), DATE '{panel.PANEL_END}'))"""


@query(f"""WITH {BASE}, {IV}
SELECT PERMNO, MthCalDt, round(ret, 6) ret FROM base b WHERE EXISTS (SELECT 1 FROM iv WHERE iv.permno = b.PERMNO AND b.MthCalDt BETWEEN iv.start AND iv.ending)""")
def interval_universe_filter(spark, d):
    return panel.universe(_base(spark, d), members(spark, d)).select("PERMNO", "MthCalDt", r("ret").alias("ret"))


@query(f"""WITH {BASE}, {IV}, h AS (SELECT b.PERMNO, b.MthCalDt, iv.start, iv.ending, row_number() OVER (PARTITION BY b.PERMNO, b.MthCalDt ORDER BY start, ending) n
  FROM base b JOIN iv ON iv.permno = b.PERMNO AND b.MthCalDt BETWEEN iv.start AND iv.ending) SELECT PERMNO, MthCalDt, start AS iv_start, ending AS iv_end FROM h WHERE n = 1""")
def interval_first_hit(spark, d):
    b = _base(spark, d).select("PERMNO", "MthCalDt")
    return intervals.first_interval_join(b, members(spark, d).distinct(), "PERMNO", "MthCalDt", "permno", "start", "ending")


@query("""WITH m AS (SELECT DISTINCT PERMNO, date_trunc('month', MthCalDt)::DATE mo FROM ccm_merged WHERE PERMNO IS NOT NULL AND MthCalDt IS NOT NULL),
f AS (SELECT *, CASE WHEN lag(mo) OVER (PARTITION BY PERMNO ORDER BY mo) + INTERVAL 1 MONTH = mo THEN 0 ELSE 1 END fr FROM m), g AS (SELECT *, sum(fr) OVER (PARTITION BY PERMNO ORDER BY mo) seg FROM f)
SELECT PERMNO entity, min(mo) AS start, last_day(max(mo)) ending FROM g GROUP BY PERMNO, seg""")
def gaps_islands_membership(spark, d):
    return intervals.months_to_intervals(table(spark, d, "ccm_merged"), "PERMNO", "MthCalDt")


@query("""SELECT DISTINCT permno, greatest(start, DATE '2005-01-01') AS start, least(coalesce(ending, DATE '2020-12-31'), DATE '2020-12-31') ending FROM sp500_constituents WHERE permno IS NOT NULL AND start IS NOT NULL
  AND greatest(start, DATE '2005-01-01') <= least(coalesce(ending, DATE '2020-12-31'), DATE '2020-12-31')""")
def interval_clip(spark, d):
    return intervals.clip_intervals(table(spark, d, "sp500_constituents"), "permno", "start", "ending", "2005-01-01", "2020-12-31")


@query("""WITH c AS (SELECT DISTINCT permno, greatest(start, DATE '2000-01-01') s, least(coalesce(ending, DATE '2024-12-31'), DATE '2024-12-31') e FROM sp500_constituents WHERE permno IS NOT NULL AND start IS NOT NULL)
SELECT month, count(DISTINCT permno)::BIGINT n FROM (SELECT permno, unnest(generate_series(date_trunc('month', s), date_trunc('month', e), INTERVAL 1 MONTH))::DATE AS month FROM c WHERE s <= e) GROUP BY 1""")
def month_expansion(spark, d):
    c = intervals.clip_intervals(table(spark, d, "sp500_constituents"), "permno", "start", "ending", panel.PANEL_START, panel.PANEL_END)
    return intervals.expand_months(c, "permno", "start", "ending").groupBy("month").agg(F.count_distinct("permno").alias("n"))


TICK = "tick AS (SELECT upper(trim(Ticker)) ticker, min(MthCalDt) AS s, max(MthCalDt) AS e FROM ccm_merged WHERE Ticker IS NOT NULL AND trim(Ticker) <> '' AND year(MthCalDt) BETWEEN 2004 AND 2015 GROUP BY 1)"


@query(f"""WITH {TICK}, mm AS (SELECT DISTINCT ticker, unnest(generate_series(date_trunc('month', s), date_trunc('month', e), INTERVAL 1 MONTH))::DATE m FROM tick),
hh AS (SELECT DISTINCT PERMNO, MthCalDt, upper(trim(Ticker)) ticker, date_trunc('month', MthCalDt)::DATE m FROM ccm_merged WHERE MthCalDt BETWEEN DATE '2000-01-01' AND DATE '2024-12-31' AND Ticker IS NOT NULL AND PERMNO IS NOT NULL),
x AS (SELECT DISTINCT PERMNO, MthCalDt FROM hh JOIN mm USING (ticker, m)), y AS (SELECT *, year(MthCalDt) * 12 + month(MthCalDt) ym FROM x), z AS (SELECT *, CASE WHEN ym - lag(ym) OVER (PARTITION BY PERMNO ORDER BY MthCalDt) = 1 THEN 0 ELSE 1 END fr FROM y),
g AS (SELECT *, sum(fr) OVER (PARTITION BY PERMNO ORDER BY MthCalDt ROWS UNBOUNDED PRECEDING) seg FROM z) SELECT PERMNO permno, min(MthCalDt) AS start, max(MthCalDt) ending FROM g GROUP BY PERMNO, seg""")
def ticker_membership(spark, d):
    ccm = table(spark, d, "ccm_merged")
    t = ccm.where((F.trim("Ticker") != "") & F.year("MthCalDt").between(2004, 2015)).groupBy(F.upper(F.trim("Ticker")).alias("ticker")).agg(F.min("MthCalDt").alias("start"), F.max("MthCalDt").alias("ending"))
    return panel.ticker_membership(t, ccm)


# --- composition -------------------------------------------------------------------------------------------------------------

RFM = f"{FACD}, rfm AS (SELECT last_day(date) mon, {_months_sql(['rf'])} FROM facd GROUP BY 1)"
DL = """dl AS (SELECT PERMNO, mon, CASE WHEN r IS NOT NULL THEN r WHEN c >= 400 AND c < 600 THEN -0.30 WHEN c IS NOT NULL THEN 0.0 END dl FROM (SELECT PERMNO, last_day(DLSTDT) mon, CASE WHEN isfinite(DLRET) THEN DLRET::DOUBLE END r, DLSTCD c,
  row_number() OVER (PARTITION BY PERMNO, last_day(DLSTDT) ORDER BY NOT coalesce(isfinite(DLRET), false), loaded_at DESC, rec_id DESC) n FROM delisting WHERE PERMNO IS NOT NULL AND DLSTDT IS NOT NULL) WHERE n = 1)"""


def rf_months(spark, d):
    return compounded(daily_factors(spark, d), ["rf"])


@query(f"WITH {BASE}, {RFM} SELECT PERMNO, b.mon AS month, round(ret - rf, 6) ex_ret FROM base b LEFT JOIN rfm USING (mon)")
def excess_return(spark, d):
    return panel.with_excess(_base(spark, d), rf_months(spark, d)).select("PERMNO", "month", r("ex_ret").alias("ex_ret"))


@query(f"WITH {BASE}, {RFM}, {DL} SELECT b.PERMNO, b.mon AS month, round(CASE WHEN dl IS NOT NULL THEN (1 + coalesce(ret - rf, 0)) * (1 + dl) - 1 ELSE ret - rf END, 6) ex_ret FROM base b LEFT JOIN rfm USING (mon) LEFT JOIN dl ON dl.PERMNO = b.PERMNO AND dl.mon = b.mon")
def delisting_compose(spark, d):
    p = panel.with_excess(_base(spark, d), rf_months(spark, d))
    return panel.with_delisting(p, panel.delisting_returns(table(spark, d, "delisting"))).select("PERMNO", "month", r("ex_ret").alias("ex_ret"))


@query(f"""WITH {BASE} SELECT mon AS month, count(*)::BIGINT n, string_agg(PERMNO::VARCHAR, ',' ORDER BY PERMNO) entities, round(sum(ret), 6) total FROM base GROUP BY 1 HAVING count(*) >= 30""")
def ragged_collect(spark, d):
    g = windows.ragged(_base(spark, d), "month", "PERMNO", "ret", ["cap", "vol"], 30)
    return g.select("month", F.size("entities").cast("long").alias("n"), F.array_join(F.transform("entities", lambda x: x.cast("string")), ",").alias("entities"), r(F.aggregate("returns", F.lit(0.0), lambda a, x: a + x)).alias("total"))


@query(f"WITH {BASE}, s AS (SELECT mon, count(*) n FROM base GROUP BY 1) SELECT count(*)::BIGINT AS months, round(avg(n), 4) mean_n, min(n)::BIGINT min_n, max(n)::BIGINT max_n FROM s")
def panel_counts(spark, d):
    s = _base(spark, d).groupBy("month").agg(F.count(F.lit(1)).alias("n"))
    return s.agg(F.count(F.lit(1)).alias("months"), r(F.avg("n"), 4).alias("mean_n"), F.min("n").alias("min_n"), F.max("n").alias("max_n"))


MOM = """mom AS (SELECT PERMNO, mon, lag(ret) OVER w m1, count(*) OVER f k, sum(CASE WHEN ret > -1 THEN ln(1 + ret) ELSE 0 END) OVER f s, min(ret) OVER f mn FROM base WINDOW w AS (PARTITION BY PERMNO ORDER BY mon),
  f AS (PARTITION BY PERMNO ORDER BY mon ROWS BETWEEN 12 PRECEDING AND 2 PRECEDING))"""
CHARS = f"""{FUND}, {MOM}, {IVOL}, chars AS (SELECT fund.PERMNO, fund.MthCalDt, fund.mon, ret, CASE WHEN cap > 0 THEN ln(cap) END log_mktcap, ceq_lag / nullif(cap / 1000, 0) bm, ib_lag / nullif(cap / 1000, 0) ep,
  CASE WHEN k = 11 AND mn > -1 THEN exp(s) - 1 WHEN k = 11 AND mn = -1 THEN -1 END mom_12_1, m1 mom_1, ni_lag / nullif(ceq_lag, 0) roe, ni_lag / nullif(at_lag, 0) roa, at_lag / nullif(at_lag_prior, 0) - 1 asset_growth, CASE WHEN shares > 0 THEN vol / (shares * 1000) END turnover, idio_vol
  FROM fund JOIN mom ON mom.PERMNO = fund.PERMNO AND mom.mon = fund.mon LEFT JOIN ivol ON ivol.PERMNO = fund.PERMNO AND ivol.mon = fund.mon)"""


#: Decimals to which sums and logs of both engines agree; the rest are quotients of single numbers, equal to the last bit.
DIGITS = {"idio_vol": 5, "mom_12_1": 6, "log_mktcap": 8}


def _chars(spark, d):
    return panel.characteristics(table(spark, d, "ccm_merged"), table(spark, d, "crsp_daily"), table(spark, d, "sp500_index"))


@query(f"WITH {CHARS} SELECT PERMNO, MthCalDt, round(ret, 6) ret, " + ", ".join(f"round({c}, {DIGITS[c]}) {c}" if c in DIGITS else c for c in panel.FEATURES) + " FROM chars")
def char_panel(spark, d):
    return _chars(spark, d).select("PERMNO", "MthCalDt", r("ret").alias("ret"), *[r(c, DIGITS[c]).alias(c) if c in DIGITS else F.col(c) for c in panel.FEATURES])


@query(f"WITH {CHARS} SELECT PERMNO, mon AS month, " + ", ".join(f"round({_rank_sql(c)}, 6) {c}" for c in panel.FEATURES) + " FROM chars")
def char_panel_ranked(spark, d):
    return panel.ranked(_chars(spark, d)).select("PERMNO", "month", *[r(c).alias(c) for c in panel.FEATURES])


PANEL_SQL = f"""WITH {CHARS}, {RFM}, {DL}, {IV},
un AS (SELECT c.*, CASE WHEN dl IS NOT NULL THEN (1 + coalesce(ret - rf, 0)) * (1 + dl) - 1 ELSE ret - rf END ex FROM chars c LEFT JOIN rfm ON rfm.mon = c.mon LEFT JOIN dl ON dl.PERMNO = c.PERMNO AND dl.mon = c.mon
  WHERE EXISTS (SELECT 1 FROM iv WHERE iv.permno = c.PERMNO AND c.MthCalDt BETWEEN iv.start AND iv.ending)),
rk AS (SELECT PERMNO, mon, ex, {_rank_sql("bm")} bm FROM un) SELECT mon AS month, count(*)::BIGINT n, string_agg(PERMNO::VARCHAR, ',' ORDER BY PERMNO) entities, round(sum(ex), 6) total_return, round(sum(bm * ex), 6) bm_return
FROM rk WHERE isfinite(ex) GROUP BY 1 HAVING count(*) >= 5"""


@query(PANEL_SQL)
def model_panel(spark, d):
    """The model's ragged panel: universe, excess returns, delisting, ranks, finite returns, arrays of each month of 5 rows or more; shown by its sums."""
    p = panel.model_panel(_chars(spark, d), members(spark, d), rf_months(spark, d), panel.delisting_returns(table(spark, d, "delisting")), least=5)
    total = F.aggregate("returns", F.lit(0.0), lambda a, x: a + x)
    by_rank = F.aggregate(F.zip_with("returns", F.transform("x", lambda v: v[panel.FEATURES.index("bm")]), lambda y, v: y * v), F.lit(0.0), lambda a, x: a + x)
    return p.select("month", F.size("entities").cast("long").alias("n"), F.array_join(F.transform("entities", lambda x: x.cast("string")), ",").alias("entities"), r(total).alias("total_return"), r(by_rank).alias("bm_return"))


# --- order, set and shape ----------------------------------------------------------------------------------------------------


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) n FROM orders) WHERE n <= 3")
def top_per_entity(spark, d):
    return windows.top_per_group(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", 3, F.col("o_totalprice").desc(), F.col("o_orderkey"))


@query("SELECT o_orderkey, o_totalprice, o_orderdate::DATE AS day FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 20")
def sorted_head(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", day("o_orderdate").alias("day"))
    return o.orderBy(F.col("o_totalprice").desc_nulls_last(), "o_orderkey").limit(20)


@query("""SELECT k, count(*)::BIGINT n, round(sum(v), 2) total FROM (SELECT 'order' k, o_totalprice v FROM orders UNION ALL SELECT 'line', l_extendedprice FROM lineitem) GROUP BY 1""")
def union_all(spark, d):
    a = table(spark, d, "orders").select(F.lit("order").alias("k"), F.col("o_totalprice").alias("v"))
    b = table(spark, d, "lineitem").select(F.lit("line").alias("k"), F.col("l_extendedprice").alias("v"))
    return a.unionByName(b).groupBy("k").agg(F.count(F.lit(1)).alias("n"), r(F.sum("v"), 2).alias("total"))


@query("""SELECT year(o_orderdate)::BIGINT y, count(*) FILTER (WHERE o_orderstatus = 'F')::BIGINT F, count(*) FILTER (WHERE o_orderstatus = 'O')::BIGINT O, count(*) FILTER (WHERE o_orderstatus = 'P')::BIGINT P FROM orders GROUP BY 1""")
def wide_pivot(spark, d):
    o = table(spark, d, "orders").select(F.year("o_orderdate").cast("long").alias("y"), "o_orderstatus")
    return o.groupBy("y").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).na.fill(0)


@query("""WITH s AS (SELECT last_day(o_orderdate::DATE) mon, count(*) n FROM orders GROUP BY 1), t AS (SELECT *, sum(n) OVER () tot FROM s), f AS (SELECT mon, n, tot, least(floor(n * least(1000, tot) / tot), n) fl, n * least(1000, tot) / tot - floor(n * least(1000, tot) / tot) re FROM t),
k AS (SELECT *, row_number() OVER (ORDER BY re DESC, mon) rk, least(1000, tot) - sum(fl) OVER () lf FROM f) SELECT mon AS month, n::BIGINT n, (fl + CASE WHEN rk <= lf AND fl < n THEN 1 ELSE 0 END)::BIGINT allocated FROM k""")
def largest_remainder_allocation(spark, d):
    s = table(spark, d, "orders").groupBy(F.last_day(day("o_orderdate")).alias("month")).agg(F.count(F.lit(1)).alias("n"))
    return sampling.largest_remainder(s, "n", 1000, "month").select("month", "n", "allocated")


@query()
def deterministic_subsample(spark, d):
    o = table(spark, d, "orders").select(F.last_day(day("o_orderdate")).alias("month"), "o_orderkey")
    return sampling.hash_sample(o, "month", "o_orderkey", 25, seed=3)


@query(f"""WITH {BASE}, o AS (SELECT mon, avg(ret) m FROM base GROUP BY 1) SELECT mon AS month, round(avg(m) OVER (ORDER BY mon ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) history_mean FROM o""")
def expanding_history(spark, d):
    o = _base(spark, d).groupBy("month").agg(F.avg("ret").alias("m"))
    return o.select("month", r(windows.expanding_mean(o, "m", "month")).alias("history_mean"))


@query("""WITH t AS (SELECT 'crsp_daily' tbl, count(*) n FROM crsp_daily UNION ALL SELECT 'ccm_merged', count(*) FROM ccm_merged UNION ALL SELECT 'delisting', count(*) FROM delisting UNION ALL SELECT 'sp500_index', count(*) FROM sp500_index)
SELECT tbl, n::BIGINT n, CASE tbl WHEN 'crsp_daily' THEN 7 WHEN 'ccm_merged' THEN 19 WHEN 'delisting' THEN 7 ELSE 5 END::INTEGER n_columns FROM t""")
def schema_profile(spark, d):
    out = None
    for name in ("crsp_daily", "ccm_merged", "delisting", "sp500_index"):
        t = table(spark, d, name)
        row = t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("tbl"), "n", F.lit(len(t.columns)).alias("n_columns"))
        out = row if out is None else out.unionByName(row)
    return out


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

