"""Queries that run the library's own readers, writers, tables and model steps on the project's tables, each with its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from panelforge.functions.scalar import finite
from panelforge.models import em, gp, hmm
from panelforge.operators import windows
from panelforge.plans import convert, evaluation, tables
from panelforge.plans.evaluation import FACM, FF5, FF5_SQL, IDXM, LS, PRED, STATE
from panelforge.plans.relational import monthly_index, r, table
from panelforge.session import ensure_checkpoint_dir, ship_package
from panelforge.sources import readers, writers

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def scratch(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{name}-{uuid.uuid4().hex}"


# --- sources and sinks -------------------------------------------------------------------------------------------------------


@query("SELECT PERMNO, date, CASE WHEN NOT isnan(RET) THEN RET END RET, VOL, CASE WHEN src NOT IN ('', 'NA', 'NaN') THEN src END src FROM crsp_daily")
def daily_from_csv(spark, d):
    """The daily table written as CSV, found by the path resolver, read as text with null tokens and cast by name."""
    out = scratch(spark, "csv")
    t = table(spark, d, "crsp_daily").select("PERMNO", F.date_format("date", "yyyy-MM-dd").alias("date"), F.col("RET").cast("string").alias("RET"), "VOL", "src")
    t.write.option("header", True).option("nullValue", "NA").csv(f"{out}/crsp_daily.csv")
    return convert.daily(spark, readers.RawFiles(out, convert.RAW_NAMES)).select("PERMNO", "date", "RET", F.col("VOL").cast("long").alias("VOL"), "src")


@query("SELECT caldt, sprtrn, vwretd, totcnt, usdcnt FROM sp500_index")
def index_converted(spark, d):
    """The index through the converter driver: raw CSV, typed table written in its place, read back; other inputs are missing and skipped."""
    out = scratch(spark, "raw")
    t = table(spark, d, "sp500_index")
    writers.write_csv(t.select(*[F.date_format(c, "yyyyMMdd").alias(c) if c == "caldt" else F.col(c).cast("string").alias(c) for c in t.columns]), f"{out}/sp500_index.csv")
    state = convert.convert_all(spark, readers.RawFiles(out, convert.RAW_NAMES), f"{out}/typed")
    if state.pop("sp500_index") != "written" or set(state.values()) != {"missing"}:
        raise RuntimeError(str(state))
    return spark.read.parquet(f"{out}/typed/sp500_index.parquet").select("caldt", "sprtrn", "vwretd", "totcnt", "usdcnt")


MACRO_SQL = "SELECT last_day(caldt) m, arg_max(totcnt, caldt)::DOUBLE vix, arg_max(usdcnt, caldt)::DOUBLE gs10 FROM sp500_index WHERE {} GROUP BY 1"


@query(f"""WITH a AS ({MACRO_SQL.format("year(caldt) < 2020")}), b AS ({MACRO_SQL.format("year(caldt) >= 2005")}),
m AS (SELECT coalesce(a.m, b.m) AS date, a.vix, b.gs10 FROM a FULL JOIN b ON a.m = b.m) SELECT date, vix, gs10, vix - lag(vix) OVER (ORDER BY date) vix_chg FROM m""")
def macro_converted(spark, d):
    """Monthly series from several CSV files of different spans, joined on their dates, with the change of the first."""
    out = scratch(spark, "macro")
    t = table(spark, d, "sp500_index").where("caldt IS NOT NULL").groupBy("caldt").agg(F.max("totcnt").alias("a"), F.max("usdcnt").alias("b"))
    for name, date, value, keep in (("vix", "DATE", "a", F.year("caldt") < 2020), ("gs10", "observation_date", "b", F.year("caldt") >= 2005)):
        writers.write_csv(t.where(keep).select(F.date_format("caldt", "yyyy-MM-dd").alias(date), F.col(value).cast("string").alias(name)), f"{out}/{name}.csv")
    return convert.macro_months(spark, readers.RawFiles(out, convert.RAW_NAMES)).select("date", "vix", "gs10", "vix_chg")


@query("""WITH i AS (SELECT caldt AS date, max(sprtrn::DOUBLE) FILTER (WHERE isfinite(sprtrn)) r FROM sp500_index GROUP BY 1), p AS (SELECT date, round(coalesce(r, 0) * 100, 4) / 100 x, r IS NULL missing FROM i)
SELECT date, CASE WHEN missing THEN NULL ELSE x::FLOAT END mkt_rf, (x / 2)::FLOAT rf FROM p""")
def factors_converted(spark, d):
    """Factor files with text around their block of days: read, the richer file over the other, per cent to fractions, missing codes to null."""
    out = scratch(spark, "factors")
    i = table(spark, d, "sp500_index").groupBy("caldt").agg(F.max(finite(F.col("sprtrn"))).alias("r"))
    rows = i.orderBy("caldt").select(F.date_format("caldt", "yyyyMMdd").alias("day"), "r").collect()  # a calendar
    percent = [(x["day"], None if x["r"] is None else round(x["r"] * 100 + 0.0, 4)) for x in rows]
    for name, head, line in (
        ("ff3_daily", ",Mkt-RF,SMB", lambda day, v: f"{day},99,{0 if v is None else v}"),
        ("ff5_daily", ",Mkt-RF,RF", lambda day, v: f"{day},{-99.99 if v is None else v},{0 if v is None else v / 2}"),
        ("mom_daily", ",Mom", lambda day, v: f"{day},-999"),
    ):
        text = ["Figures of the library", "", head, *[line(*x) for x in percent], "", "Copyright"]
        spark.createDataFrame([(n, x) for n, x in enumerate(text)], "n int, value string").coalesce(1).sortWithinPartitions("n").select("value").write.text(f"{out}/{name}.csv")
    f = convert.factor_days(spark, readers.RawFiles(out, convert.RAW_NAMES))
    over = f.withColumn("mkt_rf", F.when(F.abs("mkt_rf") < 0.9, F.col("mkt_rf")))  # the other file's 99 per cent stand where the first has no figure
    return over.select("date", "mkt_rf", "rf")


@query("SELECT 'crsp_daily' tbl, count(*)::BIGINT n, 7 n_columns FROM crsp_daily UNION ALL SELECT 'delisting', count(*), 7 FROM delisting UNION ALL SELECT 'sp500_index', count(*), 5 FROM sp500_index")
def folder_profile(spark, d):
    return readers.profile_folder(spark, {n: f"{d}/{n}.parquet" for n in ("crsp_daily", "delisting", "sp500_index")}).select("tbl", "n", "n_columns")


@query("SELECT r_regionkey::VARCHAR || ' & ' || replace(r_name, '_', '\\_') || ' & ' || printf('%.4f', r_regionkey / 3.0) || ' \\\\' AS line FROM region")
def latex_rows(spark, d):
    """The body of a printed table, read back from the rendered text."""
    t = table(spark, d, "region").select("r_regionkey", "r_name", (F.col("r_regionkey") / 3.0).alias("x")).orderBy("r_regionkey")
    return spark.createDataFrame([(x,) for x in writers.latex_table(t).splitlines()[4:-2]], "line string")


# --- tables ------------------------------------------------------------------------------------------------------------------


def _predicted(spark, d) -> DataFrame:
    return evaluation.regimes(spark, d).withColumnRenamed("state", "predicted_state")


def _portfolio(spark, d) -> DataFrame:
    return tables.portfolio_table(evaluation.forecasts(spark, d).withColumnRenamed("PERMNO", "entity"), _predicted(spark, d), evaluation.monthly_factors(spark, d), FF5)


@query(evaluation.SQL["table1"])
def prediction_table(spark, d):
    t = tables.prediction_table(evaluation.forecasts(spark, d), _predicted(spark, d))
    return t.select("model", *[r(c).alias(c) for c in ("overall", "regime_0", "regime_1")])


@query(evaluation.SQL["table2"])
def portfolio_table(spark, d):
    return _portfolio(spark, d).select("model", "state", "months", *[r(c, 5).alias(a) for c, a in (("ann_return", "ann_return"), ("ann_vol", "ann_vol"), ("sharpe", "sharpe"), ("capm_alpha", "capm"), ("max_drawdown", "max_dd"))])


@query(f"""WITH ff AS ({FF5_SQL.replace("round(CASE", "(CASE").replace("END, 5) alpha", "END) alpha")}), cm AS (WITH {LS}, {FACM} SELECT model, CASE WHEN count(*) >= 4 THEN 12 * regr_intercept(ll - sl, mkt) END alpha FROM ls JOIN fac USING (mon) GROUP BY 1)
SELECT model, round(100 * cm.alpha, 3) capm_pct, round(100 * ff.alpha, 3) ff5_pct FROM cm JOIN ff USING (model)""")
def alpha_bars(spark, d):
    return tables.alpha_bars(_portfolio(spark, d)).select("model", r("capm_pct", 3).alias("capm_pct"), r("ff5_pct", 3).alias("ff5_pct"))


@query(f"""WITH {PRED}, {STATE}, a AS (SELECT model, kernel, -1 state, actual, w * prediction prediction FROM pred, (VALUES ('se', 1.0), ('matern', 0.5)) k(kernel, w) UNION ALL SELECT model, kernel, state, actual, w * prediction FROM pred JOIN st USING (mon), (VALUES ('se', 1.0), ('matern', 0.5)) k(kernel, w)),
v AS (SELECT model, kernel, state, 1 - sum((actual - prediction) ** 2) / nullif(sum(actual * actual), 0) v FROM a GROUP BY 1, 2, 3)
SELECT model, {", ".join(f"round(max(CASE WHEN kernel = '{k}' AND state = {i} THEN v END), 6) {n}_{k}" for k in ("se", "matern") for i, n in ((-1, "overall"), (0, "regime_0"), (1, "regime_1")))} FROM v GROUP BY 1""")
def kernel_comparison(spark, d):
    """The figures of two kernels side by side; half the forecast stands in for the other kernel's."""
    f, s = evaluation.forecasts(spark, d), _predicted(spark, d)
    both = tables.prediction_table(f, s).withColumn("kernel", F.lit("se")).unionByName(tables.prediction_table(f.withColumn("prediction", F.col("prediction") * 0.5), s).withColumn("kernel", F.lit("matern")))
    p = tables.kernel_pairs(both, "se", "matern")
    return p.select("model", *[r(c).alias(c) for c in p.columns if c != "model"])


@query(f"""WITH {IDXM}, z AS (SELECT 1 + r a, 2 + sd b, 3 - r c, 4 - sd e FROM vol3 WHERE sd IS NOT NULL)
SELECT 0 regime, 'x' feature, round(avg(a), 6) lengthscale FROM z UNION ALL SELECT 0, 'y', round(avg(b), 6) FROM z UNION ALL SELECT 1, 'x', round(avg(c), 6) FROM z UNION ALL SELECT 1, 'y', round(avg(e), 6) FROM z""")
def lengthscale_table(spark, d):
    m = monthly_index(spark, d).where("sd IS NOT NULL")
    fits = m.select(F.array(F.array(1 + F.col("r"), 2 + F.col("sd")), F.array(3 - F.col("r"), 4 - F.col("sd"))).alias("lengthscales"))
    return tables.lengthscale_means(fits, ["x", "y"]).select("regime", "feature", r("lengthscale").alias("lengthscale"))


@query(evaluation.SQL["regime_probability_flags"])
def stress_series(spark, d):
    high = 1 / (1 + F.exp(-50 * (F.col("sd") - F.median("sd").over(evaluation.whole_series()))))
    p = monthly_index(spark, d).where("sd IS NOT NULL").select("month", F.array(1 - high, high).alias("next_probs"))
    episodes = spark.createDataFrame(evaluation.STRESS, "name string, lo string, hi string").select("name", F.to_date("lo").alias("lo"), F.to_date("hi").alias("hi"))
    return tables.stress_series(p, episodes).select("month", r("probability").alias("p_high"), F.col("name").alias("episode"))


# --- model steps -------------------------------------------------------------------------------------------------------------


def _series(spark, d) -> tuple[list, np.ndarray, np.ndarray]:
    m = monthly_index(spark, d).where("sd IS NOT NULL").orderBy("month").collect()  # a monthly series
    return [x["month"] for x in m], np.array([x["r"] for x in m]), np.array([x["sd"] for x in m])


_GAMMA = "1 / (1 + exp(-50 * (sd - 0.04)))"


def _gamma(sd: np.ndarray) -> np.ndarray:
    high = 1 / (1 + np.exp(-50 * (sd - 0.04)))
    return np.column_stack([1 - high, high])


@query(f"WITH {IDXM}, g AS (SELECT m, r, sd, {_GAMMA} h FROM vol3 WHERE sd IS NOT NULL), p AS (SELECT m, h, (1 - h) * 0.01 + h * -0.02 me, (1 - h) * (0.0009 + 0.0001) + h * (0.0049 + 0.0004) sq FROM g) SELECT m AS month, round(me, 6) mean, round(greatest(sq - me * me, 1e-8), 8) var FROM p")
def next_month_mixture(spark, d):
    """Mean and variance of a mixture over two regimes."""
    months, _, sd = _series(spark, d)
    rows = [(m, *em.mixture(g, np.array([[0.01], [-0.02]]), np.array([[0.0009], [0.0049]]))) for m, g in zip(months, _gamma(sd))]
    return spark.createDataFrame([(m, round(float(a[0]), 6), round(float(v[0]), 8)) for m, a, v in rows], "month date, mean double, var double")


_W, _B = np.array([[[0.0, 0.0], [20.0, 5.0]], [[0.0, 0.0], [-10.0, 30.0]]]), np.array([[0.0, -1.0], [0.0, 0.5]])


@query(f"""WITH {IDXM}, z AS (SELECT m, r, sd, row_number() OVER (ORDER BY m) i FROM vol3 WHERE sd IS NOT NULL), s AS (SELECT m, j, greatest(-30, least(30, CASE j WHEN 0 THEN 20 * r + 5 * sd - 1 ELSE -10 * r + 30 * sd + 0.5 END)) x FROM z, range(2) t(j) WHERE i > 1)
SELECT m AS month, j::INTEGER from_state, k::INTEGER to_state, round(CASE k WHEN 1 THEN 1 / (1 + exp(-x)) ELSE 1 - 1 / (1 + exp(-x)) END, 6) p FROM s, range(2) u(k)""")
def transition_tensor(spark, d):
    """Transition probabilities of every step, driven by the covariates of the month it leads into."""
    months, ret, sd = _series(spark, d)
    p = np.exp(hmm.log_transitions(_W, _B, np.column_stack([ret, sd])))
    return spark.createDataFrame([(m, j, k, round(float(p[t, j, k]), 6)) for t, m in enumerate(months[1:]) for j in range(2) for k in range(2)], "month date, from_state int, to_state int, p double")


@query(f"WITH {IDXM}, g AS (SELECT sd, {_GAMMA} h FROM vol3 WHERE sd IS NOT NULL), v AS (SELECT 0 state, sum(h * sd) / sum(h) x FROM g UNION ALL SELECT 1, sum((1 - h) * sd) / sum(1 - h) FROM g) SELECT state, (row_number() OVER (ORDER BY x) - 1)::INTEGER place FROM v")
def regime_order(spark, d):
    """Places of the regimes in order of their weighted volatility; the first given is the volatile one."""
    _, _, sd = _series(spark, d)
    order = em.volatility_order(_gamma(sd)[:, ::-1], sd)
    return spark.createDataFrame([(int(s), i) for i, s in enumerate(order)], "state int, place int")


@query(f"WITH {IDXM}, g AS (SELECT m, {_GAMMA} h FROM vol3 WHERE sd IS NOT NULL) SELECT m AS month, round(h, 6) p0, round(1 - h, 6) p1, -5.0::DOUBLE w_return, -1.5::DOUBLE intercept FROM g")
def reordered_state(spark, d):
    """A fitted state relabelled by its noise: responsibilities swap, and scores stay relative to the new first regime."""
    months, _, sd = _series(spark, d)
    g = _gamma(sd)
    w, b = np.array([[[0.0], [5.0]], [[0.0], [25.0]]]) , np.array([[0.0, 2.0], [0.0, 1.5]])
    params = [gp.GPParams(np.ones(1), 1.0, 0.3), gp.GPParams(np.ones(1), 1.0, 0.1)]
    s = em.EMState(g, np.zeros((len(g) - 1, 2, 2)), g[0], params, w, b, None).reordered(em.noise_order(params))
    return spark.createDataFrame([(m, round(float(x[0]), 6), round(float(x[1]), 6), float(s.w[1, 1, 0]), float(s.b[0, 1])) for m, x in zip(months, s.gamma)], "month date, p0 double, p1 double, w_return double, intercept double")


@query(f"WITH {IDXM}, g AS (SELECT m, {_GAMMA} h FROM vol3 WHERE sd IS NOT NULL), k AS (SELECT 0 state, m, row_number() OVER (ORDER BY 1 - h DESC, m) n FROM g UNION ALL SELECT 1, m, row_number() OVER (ORDER BY h DESC, m) FROM g) SELECT state, m AS month FROM k WHERE n <= 25")
def chosen_months(spark, d):
    """The months that each regime learns from: those of greatest responsibility."""
    months, _, sd = _series(spark, d)
    kept = em.top_months(_gamma(sd), 25) or [np.arange(len(months))] * 2
    return spark.createDataFrame([(k, months[i]) for k, c in enumerate(kept) for i in c], "state int, month date")


@query("""WITH s AS (SELECT last_day(o_orderdate::DATE) mon, count(*) n, avg(o_totalprice) w FROM orders GROUP BY 1), f AS (SELECT mon, n, 1000 * w * n / sum(w * n) OVER () raw FROM s), g AS (SELECT *, least(floor(raw), n) fl FROM f),
k AS (SELECT *, row_number() OVER (PARTITION BY fl < n ORDER BY raw - floor(raw) DESC, mon) rk, 1000 - sum(fl) OVER () lf FROM g) SELECT mon AS month, (fl + CASE WHEN fl < n AND rk <= lf THEN 1 ELSE 0 END)::BIGINT allocated FROM k""")
def allocated_points(spark, d):
    """Rows that each month gives to a forecast's training set, in proportion to weight times size."""
    o = table(spark, d, "orders").groupBy(F.last_day(F.col("o_orderdate").cast("date")).alias("month")).agg(F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("w"))
    rows = o.orderBy("month").collect()  # a monthly series
    n = em.allocate_points(np.array([x["n"] for x in rows]), np.array([x["w"] for x in rows]), 1000)
    return spark.createDataFrame([(x["month"], int(k)) for x, k in zip(rows, n)], "month date, allocated long")


def _kernel_matrix(spark, d, name: str) -> DataFrame:
    """The kernel functions on blocks of vectors against the labels' centres, as the models call them."""
    ship_package(spark)
    e = table(spark, d, "embeddings").select("vec_id", "label", "embedding")
    means = e.select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    found: dict = {}
    for x in means.limit(evaluation.CENTRE_LIMIT).collect():
        found.setdefault(x["label"], {})[x["i"]] = x["m"]
    labels = sorted(found)
    centres = np.array([[found[k][i] for i in range(len(found[k]))] for k in labels])
    kernel = gp.kernel(name)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.stack(b["embedding"].to_numpy()).astype(float) if len(b) else np.zeros((0, centres.shape[1]))
            k = kernel(x, centres, np.full(x.shape[1], np.sqrt(x.shape[1] / 32.0)), 1.5)
            yield pd.DataFrame({"vec_id": np.repeat(b["vec_id"].to_numpy(), len(labels)), "label": np.tile(labels, len(b)), "k": np.round(k.ravel(), 6)})

    kinds = dict(e.dtypes)
    return e.mapInPandas(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, k double")


@query(evaluation.SQL["se_ard_kernel"])
def se_ard_matrix(spark, d):
    return _kernel_matrix(spark, d, "se_ard")


@query(evaluation.SQL["matern52_kernel"])
def matern52_matrix(spark, d):
    return _kernel_matrix(spark, d, "matern52_ard")


@query(f"WITH {IDXM}, s AS (SELECT m, sd FROM vol3) SELECT m AS month, round(coalesce(last_value(sd IGNORE NULLS) OVER (ORDER BY m), first_value(sd IGNORE NULLS) OVER (ORDER BY m ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) vol FROM s")
def volatility_proxy(spark, d):
    """The series that starts the regimes, from the daily index."""
    from panelforge.plans.panel import volatility_proxy as proxy

    return proxy(table(spark, d, "sp500_index")).select("month", r("vol").alias("vol"))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
