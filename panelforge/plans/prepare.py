"""Queries p1, p2, p4, p5, p6 and p7 over the project's tables, with production parameters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelforge.functions.scalar import day_text, month_ordinal
from panelforge.operators.anomalies import flag_readings
from panelforge.operators.asof import known_from, version_join
from panelforge.operators.impute import filled_cells, impute_chained, measured
from panelforge.operators.intervals import merge_intervals
from panelforge.operators.trailing import daily_values, idle_spans, trailing_prefix
from panelforge.operators.units import infer_units

#: Window of the constituents, both ends included.
PANEL_LO, PANEL_HI = "2000-01-01", "2024-12-31"
#: A return is usable above a total loss.
RETURN_FLOOR = -1.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "sp500_constituents")
    m = merge_intervals(t, "permno", "start", "ending", PANEL_LO, PANEL_HI, open_end=PANEL_HI)
    return m.select(F.col("entity").alias("permno"), "kind", day_text(F.col("from_day")).alias("from_day"), day_text(F.col("to_day")).alias("to_day"))


P1_FOUND = """
WITH c AS (SELECT permno, greatest(start, DATE '2000-01-01') s, least(coalesce(ending, DATE '2024-12-31'), DATE '2024-12-31') e
  FROM sp500_constituents WHERE permno IS NOT NULL AND start IS NOT NULL),
o AS (SELECT *, max(e) OVER (PARTITION BY permno ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) pe FROM c WHERE e >= s),
g AS (SELECT *, sum(CASE WHEN pe IS NULL OR s > pe + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY permno ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) g FROM o),
p AS (SELECT permno, g, min(s) s, max(e) e FROM g GROUP BY 1, 2),
n AS (SELECT *, lead(s) OVER (PARTITION BY permno ORDER BY s) ns FROM p)
SELECT permno, 'period' kind, strftime(s, '%Y-%m-%d') from_day, strftime(e, '%Y-%m-%d') to_day FROM n
UNION ALL SELECT permno, 'gap', strftime(e + 1, '%Y-%m-%d'), strftime(ns - 1, '%Y-%m-%d') FROM n WHERE ns IS NOT NULL
"""

SPANS = (1, 7, 30)


def _trailing(spark: SparkSession, sf_dir: str, spans: tuple[int, ...]) -> tuple[DataFrame, DataFrame, DataFrame]:
    daily = table(spark, sf_dir, "crsp_daily")
    index = table(spark, sf_dir, "sp500_index")
    calendar = index.select(F.col("caldt").cast("date").alias("day"))
    values = daily_values(daily, "PERMNO", "date", "RET", floor=RETURN_FLOOR, latest=["loaded_at", "rec_id"])
    return trailing_prefix(values, calendar, spans), index, calendar


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _, _ = _trailing(spark, sf_dir, SPANS)
    return idle_spans(out, SPANS).select(F.col("entity").alias("permno"), day_text(F.col("day")).alias("day"), "span")


P4_FOUND = """
WITH u AS (SELECT DISTINCT PERMNO permno, date d FROM crsp_daily WHERE PERMNO IS NOT NULL AND date IS NOT NULL AND isfinite(RET) AND RET > -1),
b AS (SELECT permno, min(d) lo, max(d) hi FROM u GROUP BY 1),
c AS (SELECT DISTINCT caldt FROM sp500_index WHERE caldt IS NOT NULL),
g AS (SELECT b.permno, c.caldt FROM b JOIN c ON c.caldt BETWEEN b.lo AND b.hi),
l AS (SELECT g.permno, g.caldt, u.d FROM g ASOF LEFT JOIN u ON g.permno = u.permno AND g.caldt >= u.d)
SELECT permno, strftime(caldt, '%Y-%m-%d') AS day, s.span::INTEGER AS span FROM l, (VALUES (1), (7), (30)) s(span) WHERE d <= caldt - s.span
"""


def p4_trailing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trailing totals and averages of RET over 7 and 30 days with those of sprtrn beside them, for every PERMNO and trading day."""
    out, index, calendar = _trailing(spark, sf_dir, (7, 30))
    market = daily_values(index.withColumn("series", F.lit(1)), "series", "caldt", "sprtrn", floor=RETURN_FLOOR)
    idx = trailing_prefix(market, calendar, (7, 30)).drop("entity")
    idx = idx.select("day", *[F.col(c).alias(f"mkt_{c}") for c in idx.columns if c != "day"])
    both = out.join(F.broadcast(idx), "day", "left")
    r = lambda c: F.round(c, 6).alias(c)
    return both.select(
        F.col("entity").alias("permno"), day_text(F.col("day")).alias("day"),
        *[x for s in (7, 30) for x in (F.col(f"n_{s}"), r(f"total_{s}"), r(f"mean_{s}"), r(f"mkt_total_{s}"), r(f"mkt_mean_{s}"))],
    )


P4_TRAILING = """
WITH u AS (SELECT PERMNO permno, date d, arg_max(RET::DOUBLE, {'l': loaded_at, 'r': rec_id}) v FROM crsp_daily
  WHERE PERMNO IS NOT NULL AND date IS NOT NULL AND isfinite(RET) AND RET > -1 GROUP BY 1, 2),
b AS (SELECT permno, min(d) lo, max(d) hi FROM u GROUP BY 1),
m AS (SELECT caldt d, max(sprtrn::DOUBLE) v FROM sp500_index WHERE isfinite(sprtrn) AND sprtrn > -1 GROUP BY 1),
c AS (SELECT DISTINCT caldt FROM sp500_index),
g AS (SELECT b.permno, c.caldt d, false q, NULL::DOUBLE v FROM b JOIN c ON c.caldt BETWEEN b.lo AND b.hi UNION ALL SELECT permno, d, true, v FROM u),
t AS (SELECT permno, d, q, count(v) OVER a n_7, sum(v) OVER a s7, count(v) OVER z n_30, sum(v) OVER z s30 FROM g
  WINDOW a AS (PARTITION BY permno ORDER BY d RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW), z AS (PARTITION BY permno ORDER BY d RANGE BETWEEN INTERVAL 29 DAYS PRECEDING AND CURRENT ROW)),
mt AS (SELECT d, sum(v) OVER a s7, avg(v) OVER a a7, sum(v) OVER z s30, avg(v) OVER z a30 FROM m
  WINDOW a AS (ORDER BY d RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW), z AS (ORDER BY d RANGE BETWEEN INTERVAL 29 DAYS PRECEDING AND CURRENT ROW)),
mc AS (SELECT c.caldt d, mt.* EXCLUDE (d), mt.d md FROM c ASOF LEFT JOIN mt ON c.caldt >= mt.d)
SELECT t.permno, strftime(t.d, '%Y-%m-%d') AS day, n_7::BIGINT n_7, round(t.s7, 6) total_7, round(t.s7 / nullif(n_7, 0), 6) mean_7,
  round(x.s7, 6) mkt_total_7, round(x.a7, 6) mkt_mean_7, n_30::BIGINT n_30, round(t.s30, 6) total_30, round(t.s30 / nullif(n_30, 0), 6) mean_30,
  round(x.s30, 6) mkt_total_30, round(x.a30, 6) mkt_mean_30
FROM t LEFT JOIN (SELECT c.caldt d, sum(m.v) FILTER (WHERE m.d > c.caldt - 7) s7, avg(m.v) FILTER (WHERE m.d > c.caldt - 7) a7, sum(m.v) s30, avg(m.v) a30
  FROM c JOIN m ON m.d BETWEEN c.caldt - 29 AND c.caldt WHERE c.caldt BETWEEN (SELECT min(d) FROM m) AND (SELECT max(d) FROM m) GROUP BY 1) x ON x.d = t.d
WHERE NOT t.q
"""


def _statement_versions(ccm: DataFrame) -> DataFrame:
    known = known_from(F.col("fdate"), F.col("datadate"))
    rows = ccm.where("PERMNO IS NOT NULL AND datadate IS NOT NULL AND at IS NOT NULL").select(
        F.col("PERMNO").alias("entity"), known.alias("known"), "datadate", "fdate", F.col("at").cast("double").alias("at"), F.col("ceq").cast("double").alias("ceq")
    )
    return rows.withColumn("rank", F.struct("datadate", "known", "fdate"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    ccm = table(spark, sf_dir, "ccm_merged").select("rec_id", "PERMNO", "MthCalDt", "datadate", "fdate", "at", "ceq")
    early = ccm.where("PERMNO IS NOT NULL AND MthCalDt IS NOT NULL AND datadate IS NOT NULL AND at IS NOT NULL")
    early = early.where(known_from(F.col("fdate"), F.col("datadate")) > F.col("MthCalDt")).select("rec_id", "PERMNO", "MthCalDt")
    out = version_join(early, "PERMNO", "MthCalDt", _statement_versions(ccm), ["datadate", "fdate", "at", "ceq"])
    text = lambda c: F.coalesce(day_text(F.col(c)), F.lit(""))
    return out.select("rec_id", text("known_datadate").alias("datadate"), text("known_fdate").alias("fdate"))


P5_VERSIONS = """v AS (SELECT DISTINCT PERMNO, datadate, fdate, coalesce(fdate, (datadate + INTERVAL 6 MONTH)::DATE) known FROM ccm_merged
  WHERE PERMNO IS NOT NULL AND datadate IS NOT NULL AND "at" IS NOT NULL)"""
P5_FOUND = f"""
WITH {P5_VERSIONS},
e AS (SELECT rec_id, PERMNO, MthCalDt FROM ccm_merged WHERE PERMNO IS NOT NULL AND MthCalDt IS NOT NULL AND datadate IS NOT NULL AND "at" IS NOT NULL
  AND coalesce(fdate, (datadate + INTERVAL 6 MONTH)::DATE) > MthCalDt),
j AS (SELECT e.rec_id, v.datadate, v.fdate, row_number() OVER (PARTITION BY e.rec_id ORDER BY v.datadate DESC NULLS LAST, v.known DESC NULLS LAST, v.fdate DESC NULLS LAST) n
  FROM e LEFT JOIN v ON v.PERMNO = e.PERMNO AND v.known <= e.MthCalDt)
SELECT rec_id, coalesce(strftime(datadate, '%Y-%m-%d'), '') datadate, coalesce(strftime(fdate, '%Y-%m-%d'), '') fdate FROM j WHERE n = 1
"""


def p5_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every security-month with the figures that were public at its date."""
    ccm = table(spark, sf_dir, "ccm_merged").select("rec_id", "PERMNO", "MthCalDt", "datadate", "fdate", "at", "ceq")
    out = version_join(ccm.select("rec_id", "PERMNO", "MthCalDt"), "PERMNO", "MthCalDt", _statement_versions(ccm), ["datadate", "fdate", "at", "ceq"])
    return out.select("rec_id", "PERMNO", "MthCalDt", "known_datadate", "known_fdate", F.round("known_at", 4).alias("known_at"), F.round("known_ceq", 4).alias("known_ceq"))


P5_KNOWN = """
WITH v AS (SELECT PERMNO, datadate, fdate, coalesce(fdate, (datadate + INTERVAL 6 MONTH)::DATE) known, "at"::DOUBLE a, ceq::DOUBLE c FROM ccm_merged
  WHERE PERMNO IS NOT NULL AND datadate IS NOT NULL AND "at" IS NOT NULL),
j AS (SELECT e.rec_id, e.PERMNO, e.MthCalDt, v.datadate, v.fdate, v.a, v.c,
  row_number() OVER (PARTITION BY e.rec_id ORDER BY v.datadate DESC NULLS LAST, v.known DESC NULLS LAST, v.fdate DESC NULLS LAST, v.a DESC NULLS LAST, v.c DESC NULLS LAST) n
  FROM ccm_merged e LEFT JOIN v ON v.PERMNO = e.PERMNO AND v.known <= e.MthCalDt)
SELECT rec_id, PERMNO, MthCalDt, datadate known_datadate, fdate known_fdate, round(a, 4) known_at, round(c, 4) known_ceq FROM j WHERE n = 1
"""


#: Factor returns as decimal fractions are about this large: (monthly, daily).
FACTOR_SIZE = {"mkt_rf": (0.04, 0.009), "smb": (0.03, 0.005), "hml": (0.03, 0.005), "rmw": (0.02, 0.004), "cma": (0.02, 0.004), "mom": (0.04, 0.007), "rf": (0.003, 0.00015)}


FACTOR_TABLES = ("ff_factors", "ff_factors_daily")


def _figure_sql(rows: str, out: str) -> str:
    """The size of each date's figure that the reports in ``rows`` (lg, ty and what they say for each scale: u0, u2, u4) support best."""
    return f"""{out}b AS (SELECT tbl, date, f, ty, round(lg * 40)::INTEGER own, count(*) n, sum(lg) ls, sum(u0) u0, sum(u2) u2, sum(u4) u4 FROM {rows} GROUP BY ALL),
{out}c AS (SELECT tbl, date, f, ty, own - 40 * k bin, sum(u + 9.0 * n) w, sum(ls - k * n) ls, sum(n) n FROM (SELECT *, unnest([0, 2, 4]) k, unnest([u0, u2, u4]) u FROM {out}b) GROUP BY ALL),
{out}s AS (SELECT tbl, date, f, ty, sum(w) OVER q ws, sum(ls) OVER q / sum(n) OVER q lf FROM {out}c WINDOW q AS (PARTITION BY tbl, date, f ORDER BY bin RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
{out} AS (SELECT tbl, date, f, arg_max(lf, {{'a': round(ws + lf * 2.302585092994046 - 2.5 * ln(1 + (10 ** lf / ty) ** 2 / 4), 6), 'b': lf}}) lf FROM {out}s GROUP BY ALL)"""


_STEP_SQL = "greatest(0, least(4, 2 * round((lg - lf) / 2)))::INTEGER"


def _share_sql(by: str, where: str = "true") -> str:
    """Log shares l0, l2, l4 of the scales of values by ``by``."""
    logs = ", ".join(f"ln((count(*) FILTER (WHERE step = {k}) + 0.5) / (count(*) + 1.5)) l{k}" for k in (0, 2, 4))
    return f"SELECT {by}{', ' if by else ''}{logs} FROM fs WHERE {where}{' GROUP BY ' + by if by else ''}"


def units_sql(tables: tuple[str, ...]) -> str:
    """Queries that end in ``fu``: tbl, date, src, loaded_at, row_id, f, v and the step (0, 2, 4) of each usable factor value, null for a zero.

    Scales come from what all sources report for a date, from the habits of a source in its month or year, and half as much from what texts say beyond the shares of all values.
    """
    said = ", ".join(f"hb.l{k} + 0.5 * coalesce(hu.l{k} - ha.l{k}, 0) + 0.5 * coalesce(hn.l{k} - ha.l{k}, 0) u{k}" for k in (0, 2, 4))
    raw = " UNION ALL ".join(
        f"SELECT '{t}' tbl, date, src, coalesce(src, '') s, date_trunc('{'year' if t == FACTOR_TABLES[0] else 'month'}', date) mo, unit, note, loaded_at, row_id, unnest({list(FACTOR_SIZE)}) f, unnest({[v[FACTOR_TABLES.index(t)] for v in FACTOR_SIZE.values()]}) ty, unnest([{', '.join(f'{c}::DOUBLE' for c in FACTOR_SIZE)}]) v FROM {t} WHERE date IS NOT NULL"
        for t in tables
    )
    return f"""fx AS (SELECT *, nullif(lower(trim(unit)), '') xu, nullif(lower(trim(note)), '') xn, CASE WHEN v <> 0 THEN log10(abs(v)) END lg FROM ({raw}) WHERE isfinite(v) AND abs(v + 99.99) >= 0.002 AND abs(v + 999) >= 0.002),
f0 AS (SELECT *, 0.0 u0, 0.0 u2, 0.0 u4 FROM fx WHERE lg IS NOT NULL), {_figure_sql("f0", "g1")},
fs AS (SELECT f0.tbl, s, mo, xu, xn, {_STEP_SQL} step FROM f0 JOIN g1 USING (tbl, date, f)), hb AS ({_share_sql("tbl, s, mo")}), hu AS ({_share_sql("xu", "xu IS NOT NULL")}), hn AS ({_share_sql("xn", "xn IS NOT NULL")}), ha AS ({_share_sql("")}),
f1 AS (SELECT f0.* EXCLUDE (u0, u2, u4), {said} FROM f0 JOIN hb ON hb.tbl = f0.tbl AND hb.s = f0.s AND hb.mo = f0.mo LEFT JOIN hu ON hu.xu = f0.xu LEFT JOIN hn ON hn.xn = f0.xn CROSS JOIN ha), {_figure_sql("f1", "g2")},
fu AS (SELECT fx.tbl, fx.date, src, loaded_at, row_id, fx.f, v, CASE WHEN v <> 0 THEN {_STEP_SQL} END step FROM fx LEFT JOIN g2 USING (tbl, date, f))"""


def _factor_reports(spark: SparkSession, sf_dir: str, only: str | None) -> tuple[DataFrame, list[str], list, dict]:
    """Rows of both factor tables (or of ``only`` one; neither says anything of the other's units), what groups them, blocks and usual sizes."""
    read = [table(spark, sf_dir, t).select(F.lit(t).alias("tbl"), F.lit(k).alias("kind"), "row_id", "date", "src", "unit", "note", "loaded_at", *FACTOR_SIZE) for k, t in enumerate(FACTOR_TABLES) if only in (None, t)]
    sizes = {f: F.when(F.col("kind") == 0, size[0]).otherwise(size[1]) for f, size in FACTOR_SIZE.items()}
    stretch = F.when(F.col("kind") == 0, F.trunc("date", "YEAR")).otherwise(F.trunc("date", "MM"))
    return reduce(DataFrame.unionByName, read), ["kind", "date"], [F.col("kind"), stretch], sizes


def factor_units(spark: SparkSession, sf_dir: str, report: list[str] | None = None, only: str | None = None, keep: tuple[str, ...] = ("tbl", "row_id"), zeros: bool = False) -> DataFrame:
    """Every figure of both factor tables with its unit and as a fraction: tbl, row_id, field, v, unit, as_fraction, recorded_otherwise.

    ``keep``: columns to carry along. ``zeros``: with rows for zeros, which name no unit.
    """
    rows, group, block, sizes = _factor_reports(spark, sf_dir, only)
    return infer_units(rows, group, "src", block, sizes, list(keep), report, texts=(F.col("unit"), F.col("note")), out="as_fraction", zeros=zeros)


def factor_series(spark: SparkSession, sf_dir: str, tbl: str, fields: list[str]) -> DataFrame:
    """Each date of a factor table with every field as a decimal fraction: the median of what its sources delivered last.

    A zero is zero in any unit. A date on which no source has a figure of a field keeps its row, with null.
    """
    known = factor_units(spark, sf_dir, fields, tbl, ("row_id", "date", "src", "loaded_at"), zeros=True)
    last = known.groupBy("date", "src", "field").agg(F.max_by("as_fraction", F.struct("loaded_at", "row_id")).alias("x"))
    by_date = last.groupBy("date").agg(*[F.median(F.when(F.col("field") == f, F.col("x"))).alias(f) for f in fields])
    return table(spark, sf_dir, tbl).where("date IS NOT NULL").select("date").distinct().join(by_date, "date", "left")


def monthly_rf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The monthly table's risk-free rate as a fraction: month, rf."""
    return factor_series(spark, sf_dir, "ff_factors", ["rf"]).groupBy(F.last_day("date").alias("month")).agg(F.median("rf").alias("rf"))


P6_CASES = (("ff_factors", "mkt_rf"), ("ff_factors", "rf"), ("ff_factors_daily", "smb"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values whose shortest composition to the fraction isn't the identity, with the unit that the graph names."""
    units = factor_units(spark, sf_dir, [f for _, f in P6_CASES])
    asked = F.lit(False)
    for tbl, field in P6_CASES:
        asked = asked | ((F.col("tbl") == tbl) & (F.col("field") == field))
    return units.where(asked & F.col("recorded_otherwise")).select("tbl", "row_id", "field", "unit")


P6_FOUND = f"""WITH {units_sql(FACTOR_TABLES)} SELECT tbl, row_id, f AS field, CASE step WHEN 2 THEN 'percent' ELSE 'bp' END unit FROM fu
WHERE step > 0 AND ({" OR ".join(f"(tbl = '{t}' AND f = '{f}')" for t, f in P6_CASES)})"""
P6_CONVERTED = f"""WITH {units_sql(FACTOR_TABLES)} SELECT tbl, row_id, f AS field, CASE step WHEN 0 THEN 'fraction' WHEN 2 THEN 'percent' WHEN 4 THEN 'bp' END unit,
v * CASE step WHEN 2 THEN 0.01::DOUBLE WHEN 4 THEN 0.0001::DOUBLE ELSE 1.0::DOUBLE END as_fraction FROM fu"""


def p6_converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every figure of both factor tables as a decimal fraction, with the unit it was recorded in; nulls, non-finite values and missing codes are no figures."""
    return factor_units(spark, sf_dir, zeros=True).select("tbl", "row_id", "field", "unit", "as_fraction")


P7_TABLES = ("crsp_daily", "ccm_merged", "delisting")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The returns of the three tables: daily and monthly ones as series of their PERMNO, delisting ones judged by their src."""
    daily, monthly, last = (table(spark, sf_dir, t) for t in P7_TABLES)
    day = lambda c: F.datediff(F.col(c), F.lit("1970-01-01").cast("date"))
    permno = F.col("PERMNO").cast("long")
    own = permno.cast("string")
    return (
        daily.select(F.lit(0).alias("tbl"), F.col("rec_id").alias("id"), permno.alias("series"), own.alias("source"), day("date").alias("period"), F.col("RET").cast("double").alias("v"), F.lit(5).alias("min_run"))
        .unionByName(
            monthly.select(F.lit(1).alias("tbl"), F.col("rec_id").alias("id"), permno.alias("series"), own.alias("source"), month_ordinal(F.col("MthCalDt")).alias("period"), F.col("MthRet").cast("double").alias("v"), F.lit(4).alias("min_run"))
        )
        .unionByName(
            last.select(F.lit(2).alias("tbl"), F.col("rec_id").alias("id"), F.xxhash64("src", "PERMNO").alias("series"), F.col("src").alias("source"), day("DLSTDT").alias("period"), F.col("DLRET").cast("double").alias("v"), F.lit(0).alias("min_run"))
        )
    )


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = flag_readings(readings(spark, sf_dir))
    return flags.select(F.element_at(F.array(*[F.lit(t) for t in P7_TABLES]), F.col("tbl") + 1).alias("tbl"), F.col("id").alias("rec_id")).distinct()


def p7_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every flagged reading with its kind."""
    flags = flag_readings(readings(spark, sf_dir))
    return flags.select(F.element_at(F.array(*[F.lit(t) for t in P7_TABLES]), F.col("tbl") + 1).alias("tbl"), F.col("id").alias("rec_id"), "flag", F.round("p", 3).alias("p"))


#: Between these bounds a number can be a measurement of the field; both ends lie outside.
PANEL_BOUNDS = {"bm": (0.0, 100.0), "ep": (-5.0, 5.0), "roe": (-5.0, 5.0), "idio_vol": (0.0, 5.0)}
#: The eleven sector codes of the industry standard.
SECTORS = ("10", "15", "20", "25", "30", "35", "40", "45", "50", "55", "60")


def _imputed(spark: SparkSession, sf_dir: str, t: DataFrame | None = None) -> DataFrame:
    t = table(spark, sf_dir, "char_panel_raw") if t is None else t
    return impute_chained(t, "row_id", "PERMNO", "MthCalDt", PANEL_BOUNDS, "gsector", SECTORS, ("log_mktcap", "roa", "asset_growth", "turnover"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filled_cells(_imputed(spark, sf_dir), "row_id", [*PANEL_BOUNDS, "gsector"])


P2_FOUND = """
SELECT row_id, 'bm' field FROM char_panel_raw WHERE NOT coalesce(isfinite(bm) AND bm > 0 AND bm < 100, false)
UNION ALL SELECT row_id, 'ep' FROM char_panel_raw WHERE NOT coalesce(isfinite(ep) AND abs(ep) < 5, false)
UNION ALL SELECT row_id, 'roe' FROM char_panel_raw WHERE NOT coalesce(isfinite(roe) AND abs(roe) < 5, false)
UNION ALL SELECT row_id, 'idio_vol' FROM char_panel_raw WHERE NOT coalesce(isfinite(idio_vol) AND idio_vol > 0 AND idio_vol < 5, false)
UNION ALL SELECT row_id, 'gsector' FROM char_panel_raw WHERE NOT coalesce(trim(gsector) IN ('10','15','20','25','30','35','40','45','50','55','60'), false)
"""


def p2_imputed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole panel with every missing cell filled and marked."""
    return _imputed(spark, sf_dir)


def p2_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well hidden cells are filled: one cell in twenty that holds a measurement is taken out, the whole panel imputed and the fills compared.

    field, n, error (root mean square of the fills over the field's own deviation; a draw without any knowledge has 1.41) and recall (codes).
    """
    t = table(spark, sf_dir, "char_panel_raw")
    code = F.trim("gsector")
    true = {**{f: measured(F.col(f), lo, hi) for f, (lo, hi) in PANEL_BOUNDS.items()}, "gsector": F.when(code.isin(*SECTORS), code)}
    hide = lambda f: F.pmod(F.xxhash64(F.lit(f), "row_id"), F.lit(20)) == 0
    holed = t.withColumns({f: F.when(~hide(f), F.col(f)) for f in true})
    filled = _imputed(spark, sf_dir, holed).select("row_id", *[F.col(f).alias(f"x_{f}") for f in true])
    both = t.select("row_id", *[c.alias(f"y_{f}") for f, c in true.items()]).join(filled, "row_id")
    stats = [F.struct(F.lit(f).alias("field"), F.count_if(hide(f) & F.col(f"y_{f}").isNotNull()).alias("n"), F.sqrt(F.avg(F.when(hide(f), F.pow(F.col(f"y_{f}") - F.col(f"x_{f}"), 2)))).alias("e"), F.stddev_pop(f"y_{f}").alias("sd"), F.lit(None).cast("double").alias("recall")).alias(f) for f in PANEL_BOUNDS]
    stats.append(F.struct(F.lit("gsector").alias("field"), F.count_if(hide("gsector") & F.col("y_gsector").isNotNull()).alias("n"), F.lit(None).cast("double").alias("e"), F.lit(None).cast("double").alias("sd"), F.avg(F.when(hide("gsector"), (F.col("y_gsector") == F.col("x_gsector")).cast("double"))).alias("recall")).alias("gsector"))
    return both.agg(*stats).select(F.explode(F.array(*true)).alias("s")).select("s.field", "s.n", F.round(F.try_divide("s.e", "s.sd"), 4).alias("error"), F.round("s.recall", 4).alias("recall"))


def queries() -> dict:
    return {
        "p2_found": p2_found,
        "p2_holdout": p2_holdout,
        "p2_imputed": p2_imputed,
        "p7_found": p7_found,
        "p7_flags": p7_flags,
        "p6_found": p6_found,
        "p6_converted": p6_converted,
        "p1_found": p1_found,
        "p4_found": p4_found,
        "p4_trailing": p4_trailing,
        "p5_found": p5_found,
        "p5_known": p5_known,
    }


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_FOUND, "p2_found": P2_FOUND, "p4_found": P4_FOUND, "p4_trailing": P4_TRAILING, "p5_found": P5_FOUND, "p5_known": P5_KNOWN, "p6_found": P6_FOUND, "p6_converted": P6_CONVERTED}
