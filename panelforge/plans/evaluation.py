"""Queries on forecasts, portfolios, regimes, kernels and tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from panelforge.functions.scalar import argmax_array, finite, logsumexp, safe_div, softmax_ref
from panelforge.operators import metrics, sampling, windows
from panelforge.plans import panel
from panelforge.plans.relational import BASE, FACD, IDXM, IV, _base, _months_sql, compounded, daily_factors, members, monthly_index, r, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# Two forecast rules stand in for models: last month's reversal, and size.
PRED = f"""{BASE}, pm AS (SELECT PERMNO, mon, ret actual, lag(ret) OVER (PARTITION BY PERMNO ORDER BY mon) m1, cap FROM base),
pred AS (SELECT PERMNO, mon, 'reversal' model, -0.1 * m1 prediction, actual FROM pm WHERE m1 IS NOT NULL UNION ALL SELECT PERMNO, mon, 'size', 0.01 * (ln(cap) - 13), actual FROM pm WHERE m1 IS NOT NULL AND cap > 0)"""
STATE = f"{IDXM}, st AS (SELECT m mon, CASE WHEN sd > (SELECT median(sd) FROM vol3) THEN 1 ELSE 0 END state FROM vol3 WHERE sd IS NOT NULL)"


def forecasts(spark, d) -> DataFrame:
    w = Window.partitionBy("PERMNO").orderBy("month")
    p = _base(spark, d).select("PERMNO", "month", F.col("ret").alias("actual"), F.lag("ret").over(w).alias("m1"), "cap").where("m1 IS NOT NULL")
    rules = F.array(F.struct(F.lit("reversal").alias("model"), (-0.1 * F.col("m1")).alias("prediction")), F.struct(F.lit("size").alias("model"), F.when(F.col("cap") > 0, 0.01 * (F.ln("cap") - 13)).alias("prediction")))
    return p.select("PERMNO", "month", "actual", F.explode(rules).alias("x")).select("PERMNO", "month", "x.*", "actual").where("prediction IS NOT NULL")


def whole_series() -> WindowSpec:
    """All of a monthly series, a few hundred rows."""
    return Window.partitionBy()


def regimes(spark, d) -> DataFrame:
    m = monthly_index(spark, d).where("sd IS NOT NULL")
    return m.select("month", F.when(F.col("sd") > F.median("sd").over(whole_series()), 1).otherwise(0).alias("state"))


@query(f"WITH {PRED} SELECT model, count(*)::BIGINT n, round(1 - sum((actual - prediction) ** 2) / nullif(sum(actual * actual), 0), 6) r2 FROM pred GROUP BY 1")
def pooled_r2(spark, d):
    return forecasts(spark, d).groupBy("model").agg(F.count(F.lit(1)).alias("n"), r(metrics.oos_r2(F.col("actual"), F.col("prediction"))).alias("r2"))


@query(f"WITH {PRED}, {STATE} SELECT model, state, count(*)::BIGINT n, round(1 - sum((actual - prediction) ** 2) / nullif(sum(actual * actual), 0), 6) r2 FROM pred JOIN st USING (mon) GROUP BY 1, 2")
def regime_r2(spark, d):
    j = forecasts(spark, d).join(F.broadcast(regimes(spark, d)), "month")
    return j.groupBy("model", "state").agg(F.count(F.lit(1)).alias("n"), r(metrics.oos_r2(F.col("actual"), F.col("prediction"))).alias("r2"))


LS = f"""{PRED}, sz AS (SELECT *, count(*) OVER (PARTITION BY model, mon) n FROM pred), bk AS (SELECT *, ntile(10) OVER (PARTITION BY model, mon ORDER BY prediction, PERMNO) b FROM sz WHERE n >= 10),
ls AS (SELECT model, mon, avg(actual) FILTER (WHERE b = 10) ll, avg(actual) FILTER (WHERE b = 1) sl, count(*) FILTER (WHERE b = 10) nl, count(*) FILTER (WHERE b = 1) ns FROM bk GROUP BY 1, 2)"""


def portfolios(spark, d) -> DataFrame:
    return metrics.long_short(forecasts(spark, d), ["model"], "month", "prediction", "actual", "PERMNO", 10)


@query(f"WITH {LS} SELECT model, mon AS month, round(ll - sl, 6) long_short, round(ll, 6) long_leg, round(sl, 6) short_leg, nl::BIGINT n_long, ns::BIGINT n_short FROM ls")
def decile_long_short(spark, d):
    return portfolios(spark, d).select("model", "month", *[r(c).alias(c) for c in ("long_short", "long_leg", "short_leg")], "n_long", "n_short")


@query(f"WITH {LS} SELECT model, round(sqrt(12) * avg(ll - sl) / nullif(stddev_samp(ll - sl), 0), 6) sharpe, round(12 * avg(ll - sl), 6) ann_mean, round(sqrt(12) * stddev_samp(ll - sl), 6) ann_vol FROM ls GROUP BY 1")
def sharpe_vol_mean(spark, d):
    x = F.col("long_short")
    return portfolios(spark, d).groupBy("model").agg(r(metrics.sharpe(x)).alias("sharpe"), r(metrics.annual_mean(x)).alias("ann_mean"), r(metrics.annual_vol(x)).alias("ann_vol"))


DD = f"{LS}, wl AS (SELECT model, mon, product(1 + ll - sl) OVER (PARTITION BY model ORDER BY mon) w FROM ls), dd AS (SELECT model, w / nullif(max(w) OVER (PARTITION BY model ORDER BY mon), 0) - 1 d FROM wl)"


@query(f"WITH {DD} SELECT model, round(min(d), 6) max_drawdown FROM dd GROUP BY 1")
def max_drawdown(spark, d):
    return metrics.max_drawdown(portfolios(spark, d), ["model"], "month", "long_short").select("model", r("max_drawdown").alias("max_drawdown"))


FF5 = ["mkt", "smb", "hml", "rmw", "cma"]
FACM = f"{FACD}, fac AS (SELECT * FROM (SELECT last_day(date) mon, {_months_sql(FF5)} FROM facd GROUP BY 1) WHERE {' AND '.join(f'{c} IS NOT NULL' for c in FF5)})"


def monthly_factors(spark, d) -> DataFrame:
    return compounded(daily_factors(spark, d), FF5).na.drop()


@query(f"WITH {LS}, {FACM} SELECT model, round(CASE WHEN count(*) >= 4 THEN 12 * regr_intercept(ll - sl, mkt) END, 5) alpha FROM ls JOIN fac USING (mon) GROUP BY 1")
def capm_alpha(spark, d):
    j = portfolios(spark, d).join(F.broadcast(monthly_factors(spark, d)), "month")
    return j.groupBy("model").agg(r(metrics.capm_alpha(F.col("long_short"), F.col("mkt")), 5).alias("alpha"))


def _orthogonal_sql(names: list[str]) -> str:
    """Steps that make each factor orthogonal to those before it, without a constant, within a model."""
    steps = []
    for i, f in enumerate(names):
        parts = "".join(f" - q{j} * sum({f} * q{j}) OVER w / sum(q{j} * q{j}) OVER w" for j in range(i))
        steps.append(f"o{i} AS (SELECT *, {f}{parts} q{i} FROM {f'o{i - 1}' if i else 'j'} WINDOW w AS (PARTITION BY model))")
    return ", ".join(steps)


# The constant's part that no factor explains gives the intercept.
FF5_SQL = f"""WITH {LS}, {FACM}, j AS (SELECT model, ll - sl y, fac.* EXCLUDE (mon) FROM ls JOIN fac USING (mon)), {_orthogonal_sql(FF5)},
u AS (SELECT model, y, 1 {"".join(f" - q{i} * sum(q{i}) OVER w / sum(q{i} * q{i}) OVER w" for i in range(5))} u FROM o4 WINDOW w AS (PARTITION BY model))
SELECT model, round(CASE WHEN count(*) >= 8 THEN 12 * sum(u * y) / sum(u * u) END, 5) alpha FROM u GROUP BY 1"""


@query(FF5_SQL)
def ff5_alpha(spark, d):
    j = portfolios(spark, d).join(F.broadcast(monthly_factors(spark, d)), "month")
    return metrics.factor_alpha(j, "long_short", FF5, ["model"]).select("model", r("alpha", 5).alias("alpha"))


@query(f"""WITH {PRED}, {STATE}, a AS (SELECT model, -1 state, actual, prediction FROM pred UNION ALL SELECT model, state, actual, prediction FROM pred JOIN st USING (mon))
SELECT model, round(max(CASE WHEN state = -1 THEN v END), 6) overall, round(max(CASE WHEN state = 0 THEN v END), 6) regime_0, round(max(CASE WHEN state = 1 THEN v END), 6) regime_1
FROM (SELECT model, state, 1 - sum((actual - prediction) ** 2) / nullif(sum(actual * actual), 0) v FROM a GROUP BY 1, 2) GROUP BY 1""")
def table1(spark, d):
    j = forecasts(spark, d).join(F.broadcast(regimes(spark, d)), "month", "left")
    of = lambda cond: safe_div(F.sum(F.when(cond, F.pow(F.col("actual") - F.col("prediction"), 2))), F.sum(F.when(cond, F.col("actual") * F.col("actual"))))
    s = F.col("state")
    t = j.groupBy("model").agg(r(metrics.oos_r2(F.col("actual"), F.col("prediction"))).alias("overall"), r(1 - of(s == 0)).alias("regime_0"), r(1 - of(s == 1)).alias("regime_1"))
    return t.orderBy(F.col("overall").desc())


@query(f"""WITH {LS}, {STATE}, {FACM}, al AS (SELECT model, -1 state, mon, ll - sl x FROM ls UNION ALL SELECT model, state, mon, ll - sl FROM ls JOIN st USING (mon)), wv AS (SELECT model, state, mon, product(1 + x) OVER (PARTITION BY model, state ORDER BY mon) w FROM al),
dd AS (SELECT model, state, min(q) md FROM (SELECT model, state, w / nullif(max(w) OVER (PARTITION BY model, state ORDER BY mon), 0) - 1 q FROM wv) GROUP BY 1, 2),
mm AS (SELECT model, state, count(*) n, 12 * avg(x) am, sqrt(12) * stddev_samp(x) av, sqrt(12) * avg(x) / nullif(stddev_samp(x), 0) sh FROM al GROUP BY 1, 2),
aa AS (SELECT model, state, CASE WHEN count(*) >= 4 THEN 12 * regr_intercept(x, mkt) END ca FROM al JOIN fac USING (mon) GROUP BY 1, 2)
SELECT mm.model, mm.state::INTEGER state, n::BIGINT AS months, round(am, 5) ann_return, round(av, 5) ann_vol, round(sh, 5) sharpe, round(ca, 5) capm, round(md, 5) max_dd FROM mm JOIN dd ON dd.model = mm.model AND dd.state = mm.state LEFT JOIN aa ON aa.model = mm.model AND aa.state = mm.state""")
def table2(spark, d):
    p = portfolios(spark, d).select("model", "month", "long_short")
    s = regimes(spark, d)
    both = p.withColumn("state", F.lit(-1)).unionByName(p.join(F.broadcast(s), "month"))
    x = F.col("long_short")
    keys = ["model", "state"]
    main = both.groupBy(*keys).agg(F.count(F.lit(1)).alias("months"), r(metrics.annual_mean(x), 5).alias("ann_return"), r(metrics.annual_vol(x), 5).alias("ann_vol"), r(metrics.sharpe(x), 5).alias("sharpe"))
    alpha = both.join(F.broadcast(monthly_factors(spark, d)), "month").groupBy(*keys).agg(r(metrics.capm_alpha(x, F.col("mkt")), 5).alias("capm"))
    fall = metrics.max_drawdown(both, keys, "month", "long_short").select(*keys, r("max_drawdown", 5).alias("max_dd"))
    return main.join(alpha, keys, "left").join(fall, keys)


#: Stress episodes of the market, whole months.
STRESS = [("dotcom", "2000-03-01", "2002-10-31"), ("credit", "2007-12-01", "2009-06-30"), ("pandemic", "2020-02-01", "2020-04-30")]


@query(f"""WITH {IDXM} SELECT m AS month, round(1 / (1 + exp(-50 * (sd - (SELECT median(sd) FROM vol3)))), 6) p_high,
  CASE WHEN m BETWEEN DATE '2000-03-01' AND DATE '2002-10-31' THEN 'dotcom' WHEN m BETWEEN DATE '2007-12-01' AND DATE '2009-06-30' THEN 'credit' WHEN m BETWEEN DATE '2020-02-01' AND DATE '2020-04-30' THEN 'pandemic' END episode FROM vol3 WHERE sd IS NOT NULL""")
def regime_probability_flags(spark, d):
    m = monthly_index(spark, d).where("sd IS NOT NULL")
    episodes = F.broadcast(spark.createDataFrame(STRESS, "episode string, lo string, hi string").select("episode", F.to_date("lo").alias("lo"), F.to_date("hi").alias("hi")))
    p = m.select("month", r(1 / (1 + F.exp(-50 * (F.col("sd") - F.median("sd").over(whole_series()))))).alias("p_high"))
    return p.join(episodes, F.col("month").between(F.col("lo"), F.col("hi")), "left").select("month", "p_high", "episode")


@query(f"""WITH {BASE}, pm AS (SELECT PERMNO, mon, ret y, lag(ret) OVER (PARTITION BY PERMNO ORDER BY mon) x FROM base), co AS (SELECT mon, regr_slope(y, x) b, regr_intercept(y, x) a FROM pm WHERE x IS NOT NULL GROUP BY 1 HAVING count(*) >= 10),
ex AS (SELECT mon, avg(b) OVER w b, avg(a) OVER w a FROM co WINDOW w AS (ORDER BY mon ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT PERMNO, mon AS month, round(a + b * x, 6) prediction, round(y, 6) actual FROM pm JOIN ex USING (mon) WHERE x IS NOT NULL AND a IS NOT NULL""")
def fama_macbeth_univariate(spark, d):
    w = Window.partitionBy("PERMNO").orderBy("month")
    p = _base(spark, d).select("PERMNO", "month", F.col("ret").alias("y"), F.lag("ret").over(w).alias("x")).where("x IS NOT NULL")
    co = p.groupBy("month").agg(F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"), F.count(F.lit(1)).alias("n")).where("n >= 10")
    ex = co.select("month", windows.expanding_mean(co, "b", "month").alias("b"), windows.expanding_mean(co, "a", "month").alias("a")).where("a IS NOT NULL")
    return p.join(F.broadcast(ex), "month").select("PERMNO", "month", r(F.col("a") + F.col("b") * F.col("x")).alias("prediction"), r("y").alias("actual"))


# --- kernels, transitions, filtering -----------------------------------------------------------------------------------------


def _dist2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


#: Labels whose centres may be broadcast beside the vectors.
CENTRE_LIMIT = 10_000


def _distances(spark, d) -> DataFrame:
    """Scaled squared distance of every vector to every label's centre: the centres, a counted few, lie beside each vector in one array. The squared length scale is a 32nd of the dimensions."""
    e = table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    means = e.select("label", F.posexplode("x").alias("i", "v")).groupBy("label", "i").agg(F.avg("v").alias("m")).groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "m"))).alias("c"))  # one array a label
    if len(means.select("label").take(CENTRE_LIMIT + 1)) > CENTRE_LIMIT:
        raise ValueError("more labels than CENTRE_LIMIT")
    centres = means.select(F.lit(1).alias("__one"), F.struct("label", F.col("c.m").alias("c")).alias("c")).groupBy("__one").agg(F.collect_list("c").alias("cs"))
    both = e.select("vec_id", "x", F.lit(1).alias("__one")).join(F.broadcast(centres), "__one").select("vec_id", "x", F.explode("cs").alias("c"))
    return both.select("vec_id", "c.label", (_dist2(F.col("x"), F.col("c.c")) / (F.size("x") / 32.0)).alias("d2"))


KERN = """e AS (SELECT vec_id, label, list_transform(embedding, lambda q: q::DOUBLE) x FROM embeddings), u AS (SELECT vec_id, label, len(x) n, unnest(x) v, generate_subscripts(x, 1) i FROM e), c AS (SELECT label, i, avg(v) m FROM u GROUP BY 1, 2),
q AS (SELECT u.vec_id, c.label, sum((u.v - c.m) ** 2) / (max(u.n) / 32.0) d2 FROM u JOIN c USING (i) GROUP BY 1, 2)"""


@query(f"WITH {KERN} SELECT vec_id, label, round(1.5 * exp(-0.5 * d2), 6) k FROM q")
def se_ard_kernel(spark, d):
    return _distances(spark, d).select("vec_id", "label", r(1.5 * F.exp(-0.5 * F.col("d2"))).alias("k"))


@query(f"WITH {KERN} SELECT vec_id, label, round(1.5 * (1 + sqrt(5 * d2) + 5 * d2 / 3) * exp(-sqrt(5 * d2)), 6) k FROM q")
def matern52_kernel(spark, d):
    return _distances(spark, d).select("vec_id", "label", r(1.5 * (1 + F.sqrt(5 * F.col("d2")) + 5 * F.col("d2") / 3) * F.exp(-F.sqrt(5 * F.col("d2")))).alias("k"))


@query(f"WITH {IDXM} SELECT m AS month, round(1 / (1 + exp(greatest(-30, least(30, 0.5 + 20 * r - 5 * sd)))), 6) p0, round(1 - 1 / (1 + exp(greatest(-30, least(30, 0.5 + 20 * r - 5 * sd)))), 6) p1 FROM vol3 WHERE sd IS NOT NULL")
def softmax_transition(spark, d):
    m = monthly_index(spark, d).where("sd IS NOT NULL")
    p = softmax_ref([0.5 + 20 * F.col("r") - 5 * F.col("sd")])
    return m.select("month", r(p[0]).alias("p0"), r(p[1]).alias("p1"))


MU, SD, STAY = (0.01, -0.01), (0.03, 0.07), 0.9


def _log_emission(x: Column, k: int) -> Column:
    return -0.5 * F.pow((x - MU[k]) / SD[k], 2) - F.log(F.lit(SD[k])) - 0.9189385332046727


HMM_SQL = f"""WITH RECURSIVE {IDXM}, o AS (SELECT row_number() OVER (ORDER BY m) i, m, -0.5 * ((r - 0.01) / 0.03) ** 2 - ln(0.03) - 0.9189385332046727 e0, -0.5 * ((r + 0.01) / 0.07) ** 2 - ln(0.07) - 0.9189385332046727 e1 FROM idxm),
f(i, a0, a1) AS (SELECT i, ln(0.5) + e0, ln(0.5) + e1 FROM o WHERE i = 1 UNION ALL SELECT o.i, e0 + greatest(a0 + ln(0.9), a1 + ln(0.1)) + ln(1 + exp(-abs(a0 + ln(0.9) - a1 - ln(0.1)))), e1 + greatest(a0 + ln(0.1), a1 + ln(0.9)) + ln(1 + exp(-abs(a0 + ln(0.1) - a1 - ln(0.9)))) FROM f JOIN o ON o.i = f.i + 1)
SELECT o.m AS month, round(greatest(a0, a1) + ln(1 + exp(-abs(a0 - a1))), 5) log_lik, round(1 / (1 + exp(a0 - a1)), 5) p1 FROM f JOIN o USING (i)"""


@query(HMM_SQL)
def hmm_forward_loglik(spark, d):
    """Running log likelihood and filtered probability of two Gaussian states, folded over the sorted series inside one expression."""
    m = monthly_index(spark, d).select("month", _log_emission(F.col("r"), 0).alias("e0"), _log_emission(F.col("r"), 1).alias("e1"))
    series = m.agg(F.sort_array(F.collect_list(F.struct("month", "e0", "e1"))).alias("s"))  # a monthly series
    stay, go = F.log(F.lit(STAY)), F.log(F.lit(1 - STAY))
    half = F.log(F.lit(0.5))

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        a0 = F.when(F.size(acc) == 0, half + x["e0"]).otherwise(x["e0"] + logsumexp([last["a0"] + stay, last["a1"] + go]))
        a1 = F.when(F.size(acc) == 0, half + x["e1"]).otherwise(x["e1"] + logsumexp([last["a0"] + go, last["a1"] + stay]))
        return F.concat(acc, F.array(F.struct(x["month"].alias("month"), a0.alias("a0"), a1.alias("a1"))))

    empty = F.expr("cast(array() as array<struct<month:date,a0:double,a1:double>>)")
    with_get = lambda acc, x: step(acc, x)
    rows = series.select(F.explode(F.aggregate("s", empty, with_get)).alias("f")).select("f.*")
    return rows.select("month", r(logsumexp([F.col("a0"), F.col("a1")]), 5).alias("log_lik"), r(1 / (1 + F.exp(F.col("a0") - F.col("a1"))), 5).alias("p1"))


@query("""SELECT l_partkey % 50 k, round(sum(p * m), 6) mean, round(greatest(sum(p * (v + m * m)) - sum(p * m) ** 2, 1e-8), 6) var FROM (SELECT l_partkey, l_tax / nullif(sum(l_tax) OVER (PARTITION BY l_partkey % 50), 0) p, l_discount m, l_discount * l_discount v FROM lineitem) GROUP BY 1""")
def mixture_moments(spark, d):
    t = table(spark, d, "lineitem").select((F.col("l_partkey") % 50).alias("k"), "l_tax", F.col("l_discount").alias("m"))
    # two aggregates instead of a window over a group of unbounded size
    s = t.groupBy("k").agg(F.sum("l_tax").alias("w"), F.sum(F.col("l_tax") * F.col("m")).alias("wm"), F.sum(F.col("l_tax") * 2 * F.col("m") * F.col("m")).alias("wv"))
    mean = safe_div(F.col("wm"), F.col("w"))
    return s.select("k", r(mean).alias("mean"), r(F.greatest(safe_div(F.col("wv"), F.col("w")) - mean * mean, F.lit(1e-8))).alias("var"))


@query(f"WITH {STATE}, g AS (SELECT m mon, state, sd FROM vol3 JOIN st ON st.mon = vol3.m) SELECT state, mon AS month FROM (SELECT *, row_number() OVER (PARTITION BY state ORDER BY sd DESC, mon) n FROM g) WHERE n <= 25")
def top_months_per_regime(spark, d):
    j = monthly_index(spark, d).join(F.broadcast(regimes(spark, d)), "month")
    return windows.top_per_group(j, "state", 25, F.col("sd").desc(), F.col("month")).select("state", "month")


@query(f"WITH {STATE}, w AS (SELECT state, sum(r * sd) / sum(sd) x FROM vol3 JOIN st ON st.mon = vol3.m GROUP BY 1) SELECT state, round(x, 6) weighted FROM w")
def weighted_average(spark, d):
    j = monthly_index(spark, d).join(F.broadcast(regimes(spark, d)), "month")
    return j.groupBy("state").agg(r(safe_div(F.sum(F.col("r") * F.col("sd")), F.sum("sd"))).alias("weighted"))


@query(f"WITH {IDXM} SELECT m AS month, round(p1, 6) p0, round(p0, 6) p1, (CASE WHEN p1 >= p0 THEN 0 ELSE 1 END)::INTEGER top FROM (SELECT m, 1 / (1 + exp(20 * r)) p0, 1 - 1 / (1 + exp(20 * r)) p1 FROM idxm)")
def label_permutation(spark, d):
    """Regime probabilities with their labels swapped by an order array, and the likeliest label."""
    m = monthly_index(spark, d).select("month", F.array(*softmax_ref([20 * F.col("r")])).alias("p"))
    q = m.select("month", sampling.permute(F.col("p"), F.array(F.lit(1), F.lit(0))).alias("q"))
    return q.select("month", r(F.col("q")[0]).alias("p0"), r(F.col("q")[1]).alias("p1"), argmax_array(F.col("q")).alias("top"))


@query("SELECT label, i AS feature, round(avg(v), 6) mean_value FROM (SELECT label, unnest(embedding)::DOUBLE v, generate_subscripts(embedding, 1) - 1 i FROM embeddings) GROUP BY 1, 2")
def vector_means(spark, d):
    e = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("feature", "v"))
    return e.groupBy("label", F.col("feature").cast("long").alias("feature")).agg(r(F.avg(F.col("v").cast("double"))).alias("mean_value"))


GRID = 80


@query(f"""WITH {IDXM}, z AS (SELECT sd FROM vol3 WHERE sd IS NOT NULL), b AS (SELECT quantile_cont(sd, 0.05) lo, quantile_cont(sd, 0.95) hi FROM z), g AS (SELECT i, lo + (hi - lo) * i / 79 v FROM b, range(80) t(i)),
p AS (SELECT m, 40 + 200 * r AS w, -2 + 10 * sd AS c FROM vol3 WHERE sd IS NOT NULL), x AS (SELECT i, v, 1 / (1 + exp(-greatest(-30, least(30, w * v + c)))) q FROM g, p)
SELECT i::INTEGER step, round(max(v), 6) level, round(avg(q), 6) mean_p, round(quantile_cont(q, 0.1), 6) p10, round(quantile_cont(q, 0.9), 6) p90 FROM x GROUP BY 1""")
def covariate_sensitivity(spark, d):
    """Probability of the second state along a grid of the covariate, averaged over fits (one a month), with a band."""
    m = monthly_index(spark, d).where("sd IS NOT NULL")
    q = F.percentile("sd", F.array(F.lit(0.05), F.lit(0.95))).over(whole_series())
    fits = m.select((40 + 200 * F.col("r")).alias("w"), (-2 + 10 * F.col("sd")).alias("c"), q.alias("q"))
    x = fits.select("w", "c", "q", F.explode(F.sequence(F.lit(0), F.lit(GRID - 1))).alias("step")).withColumn("v", F.col("q")[0] + (F.col("q")[1] - F.col("q")[0]) * F.col("step") / (GRID - 1))
    p = softmax_ref([F.col("w") * F.col("v") + F.col("c")])[1]
    return x.select("step", "v", p.alias("p")).groupBy("step").agg(r(F.max("v")).alias("level"), r(F.avg("p")).alias("mean_p"), r(F.percentile("p", 0.1)).alias("p10"), r(F.percentile("p", 0.9)).alias("p90"))


# --- quality -----------------------------------------------------------------------------------------------------------------


@query("""WITH a AS (SELECT DISTINCT PERMNO FROM ccm_merged WHERE PERMNO IS NOT NULL), b AS (SELECT DISTINCT PERMNO FROM crsp_daily WHERE PERMNO IS NOT NULL)
SELECT (SELECT count(*) FROM a)::BIGINT n_ccm, (SELECT count(*) FROM b)::BIGINT n_crsp, (SELECT count(*) FROM a JOIN b USING (PERMNO))::BIGINT n_both""")
def id_overlap(spark, d):
    a = table(spark, d, "ccm_merged").where("PERMNO IS NOT NULL").select("PERMNO").distinct()
    b = table(spark, d, "crsp_daily").where("PERMNO IS NOT NULL").select("PERMNO").distinct()
    j = a.withColumn("a", F.lit(1)).join(b.withColumn("b", F.lit(1)), "PERMNO", "full_outer")
    return j.agg(F.count("a").alias("n_ccm"), F.count("b").alias("n_crsp"), F.count(F.col("a") + F.col("b")).alias("n_both"))


@query(f"""WITH {BASE}, {IV}, h AS (SELECT DISTINCT b.PERMNO, b.mon FROM base b JOIN iv ON iv.permno = b.PERMNO AND b.MthCalDt BETWEEN iv.start AND iv.ending),
s AS (SELECT mon, count(*) n FROM h GROUP BY 1) SELECT count(*)::BIGINT AS months, min(mon) first_month, max(mon) last_month, round(avg(n), 4) mean_n, min(n)::BIGINT min_n, max(n)::BIGINT max_n FROM s""")
def constituent_coverage(spark, d):
    u = panel.universe(_base(spark, d), members(spark, d)).groupBy("month").agg(F.count(F.lit(1)).alias("n"))
    return u.agg(F.count(F.lit(1)).alias("months"), F.min("month").alias("first_month"), F.max("month").alias("last_month"), r(F.avg("n"), 4).alias("mean_n"), F.min("n").alias("min_n"), F.max("n").alias("max_n"))


@query("SELECT src, round(avg(mkt_rf::DOUBLE), 6) mean, round(stddev_samp(mkt_rf::DOUBLE), 6) sd, abs(avg(mkt_rf::DOUBLE)) > 0.1 suspicious FROM ff_factors WHERE isfinite(mkt_rf) AND mkt_rf > -99 GROUP BY 1")
def factor_unit_check(spark, d):
    v = finite(F.col("mkt_rf"))
    t = table(spark, d, "ff_factors").select("src", v.alias("v")).where("v > -99")
    return t.groupBy("src").agg(r(F.avg("v")).alias("mean"), r(F.stddev_samp("v")).alias("sd"), (F.abs(F.avg("v")) > 0.1).alias("suspicious"))


@query(f"""WITH {BASE} SELECT 'ret' AS column, count(*)::BIGINT n, round(avg(ret), 6) mean, round(quantile_cont(ret, 0.01), 6) p01, round(quantile_cont(ret, 0.5), 6) p50, round(quantile_cont(ret, 0.99), 6) p99 FROM base
UNION ALL SELECT 'cap', count(*)::BIGINT, round(avg(cap), 6), round(quantile_cont(cap, 0.01), 6), round(quantile_cont(cap, 0.5), 6), round(quantile_cont(cap, 0.99), 6) FROM base""")
def characteristic_stats(spark, d):
    p = windows.finite_profile(_base(spark, d), ["ret", "cap"])
    return p.select("column", "n", r("mean").alias("mean"), r(F.col("q")[0]).alias("p01"), r(F.col("q")[1]).alias("p50"), r(F.col("q")[2]).alias("p99"))


# --- optional: windows on the event table ------------------------------------------------------------------------------------


@query("SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) hour_start, count(*)::BIGINT n, round(sum(value), 4) total FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    from panelforge.streaming.events import hourly_totals

    return hourly_totals(table(spark, d, "events")).select("event_type", "hour_start", "n", r("total", 4).alias("total"))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

