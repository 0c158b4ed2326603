"""One surviving record for each group of duplicates, with a latent two-sided model of how far each source can be trusted."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from panelforge.session import cut_lineage

#: Sources are a declared vocabulary of at most this many, so there are at most 3 ** 8 claim patterns and the model fits on their counts.
SOURCE_LIMIT = 8


#: By how much, in nats, the say of a more trusted source exceeds that of all less trusted ones together where the order is declared.
TRUST_MARGIN = 0.5


@dataclass(frozen=True)
class SourceQuality:
    """Sensitivity and specificity of each source, the share of true claims, and log odds and posterior of each (claims, present) pattern."""

    sensitivity: np.ndarray
    specificity: np.ndarray
    prior: float
    posterior: dict[tuple[int, int], float]
    log_odds: dict[tuple[int, int], float]


def _log_share(logit: np.ndarray) -> np.ndarray:
    """Log of the share with these log odds."""
    return -np.logaddexp(0.0, -logit)


def _ordered(sens: np.ndarray, spec: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logits raised, least trusted source first, until each source's claim outweighs the claims of all after it together."""
    sens, spec, below = sens.copy(), spec.copy(), 0.0
    for s in range(len(sens) - 1, -1, -1):
        lack = max(0.0, below + TRUST_MARGIN - sens[s] - spec[s])
        sens[s] += lack / 2
        spec[s] += lack / 2
        below += sens[s] + spec[s]
    return sens, spec


def fit_two_sided(patterns: dict[tuple[int, int], int], n_sources: int, iterations: int = 50, prior_sens: tuple[float, float] = (9.0, 1.0), prior_spec: tuple[float, float] = (9.0, 1.0), ordered: bool = False) -> SourceQuality:
    """Expectation-maximisation over counted patterns.

    A pattern is a value of a group seen from all sources: bit s of ``present`` says that source s has a record in the group, bit s of
    ``claims`` that it gives this value. A true value is claimed with the source's sensitivity, a false one with one minus its
    specificity; several values of a group may be true. Beta priors (hits, misses) keep rarely seen sources near their mean.

    ``ordered``: sources are declared in order of trust, and every maximisation keeps to it: a claim of source s changes the log odds
    (by the logits of its sensitivity and specificity) by more than the claims of all sources after it. What the data say decides how
    sure a value is; between values claimed by different sources the declared order then shows in the posterior itself.
    """
    keys = sorted(patterns)
    n = np.array([patterns[k] for k in keys], float)
    bit = lambda m: np.array([[(x >> s) & 1 for s in range(n_sources)] for x in m], float).reshape(len(keys), n_sources)
    claim, present = bit([k[0] for k in keys]), bit([k[1] for k in keys])
    logit = lambda hits, misses: np.clip(np.log(hits / misses), -9.2, 9.2)
    sens, spec = np.full(n_sources, logit(*prior_sens)), np.full(n_sources, logit(*prior_spec))
    if ordered:
        sens, spec = _ordered(sens, spec)
    beta, odds, p = 0.0, np.zeros(len(keys)), np.zeros(len(keys))
    for _ in range(iterations if keys else 0):
        yes = claim * _log_share(sens) + (1 - claim) * _log_share(-sens)
        no = claim * _log_share(-spec) + (1 - claim) * _log_share(spec)
        odds = beta + (present * (yes - no)).sum(1)
        p = np.exp(_log_share(odds))
        w1, w0 = (n * p)[:, None] * present, (n * (1 - p))[:, None] * present
        sens = logit((w1 * claim).sum(0) + prior_sens[0], (w1 * (1 - claim)).sum(0) + prior_sens[1])
        spec = logit((w0 * (1 - claim)).sum(0) + prior_spec[0], (w0 * claim).sum(0) + prior_spec[1])
        if ordered:
            sens, spec = _ordered(sens, spec)
        beta = float(logit((n * p).sum() + 1, (n * (1 - p)).sum() + 1))
    as_share = lambda x: np.exp(_log_share(x))
    return SourceQuality(as_share(sens), as_share(spec), float(as_share(beta)), {k: float(x) for k, x in zip(keys, p)}, {k: float(x) for k, x in zip(keys, odds)})


def source_rank(source: Column, trust: tuple[str | None, ...]) -> Column:
    """Position in the declared order (None stands for null); what is not declared comes last."""
    out = F.lit(len(trust))
    for i, s in reversed(list(enumerate(trust))):
        out = F.when(source.isNull() if s is None else source == s, i).otherwise(out)
    return out


def _models(counted: list, n_sources: int, ordered: set[int]) -> dict[int, SourceQuality]:
    """One model a field from rows (field, claims, present, n)."""
    patterns: dict[int, dict[tuple[int, int], int]] = {}
    for r in counted:
        patterns.setdefault(r["field"], {})[r["claims"], r["present"]] = r["n"]
    return {f: fit_two_sided(p, n_sources, ordered=f in ordered) for f, p in patterns.items()}


def survivors(
    df: DataFrame,
    group: tuple[Column, Column],
    key_field: str,
    period_end: str,
    limit_day: str,
    source: str,
    trust: tuple[str | None, ...],
    latest: str,
    fields: tuple[str, ...] = (),
    multi: str | None = None,
    least_records: int = 2,
    truth: float = 0.5,
    judged: tuple[str, ...] = (),
) -> DataFrame:
    """One record for each group of ``least_records`` or more, chosen field by field by the two-sided model.

    What a source claims for a field is the non-null value of its latest record (of several, the greatest). A field's model is fitted by
    expectation-maximisation on how often each pattern of claims occurs, and the value of greatest posterior log odds survives. For
    ``key_field`` and ``fields`` the declared order of trust binds the model; for ``judged`` fields it doesn't, so several sources or a
    better one may overrule the first (ties go to the more trusted source). ``period_end``: the latest in the group's records with
    the surviving key not after their own ``limit_day`` (null if none). ``multi``: every value of that field (trimmed, upper case),
    of all records, that its model judges true, as a sorted array.

    Result: g1, g2, n_records, key_field, key_p (posterior), key_first (the exact check: whether it is the most trusted source's latest
    value), period_end, fields, judged and ``<multi>_values``. Cases: rows with a null group key are ignored; without any key value
    key, posterior, check and period end are null; repeats count as records; a null ``latest`` is the earliest; an empty table gives
    no rows; other columns are never looked at. Groups are folded by map-side combinable aggregates, first by (group, value), then by
    group to one claim a source (at most SOURCE_LIMIT), so none is gathered in one place; what is folded is written once to the
    checkpoint folder, and only counts of patterns reach the driver.
    """
    if len(trust) + 1 > SOURCE_LIMIT:
        raise ValueError("too many sources")
    n_sources, others = len(trust) + 1, (*fields, *judged)
    ranks = range(n_sources)
    wanted = dict.fromkeys([key_field, period_end, limit_day, latest, *others, *([multi] if multi else [])])
    rows = df.select(group[0].alias("g1"), group[1].alias("g2"), source_rank(F.col(source), trust).alias("rank"), *[F.col(c).alias(f"c_{c}") for c in wanted])
    rows = rows.where(F.col("g1").isNotNull() & F.col("g2").isNotNull())
    at = F.coalesce(F.unix_micros(F.col(f"c_{latest}").cast("timestamp")), F.lit(-(2**62)))
    end, limit = F.col(f"c_{period_end}"), F.col(f"c_{limit_day}")
    of = lambda s, c: F.max(F.when(F.col("rank") == s, c))
    by_value = rows.groupBy("g1", "g2", F.col(f"c_{key_field}").alias("value")).agg(
        F.max(F.when(end <= limit, end)).alias("end"), F.count(F.lit(1)).alias("n"), F.bit_or(F.expr("shiftleft(1, rank)")).alias("present"), *[of(s, at).alias(f"at_{s}") for s in ranks],
        *[F.max(F.when((F.col("rank") == s) & F.col(f"c_{f}").isNotNull(), F.struct(at.alias("at"), F.col(f"c_{f}").alias("v")))).alias(f"o{i}_{s}") for i, f in enumerate(others, 1) for s in ranks],
    )
    claim = lambda s: F.max(F.when(F.col("value").isNotNull() & F.col(f"at_{s}").isNotNull(), F.struct(F.col(f"at_{s}").alias("at"), F.col("value").alias("v"), F.col("end").alias("e"))))
    gathered = by_value.groupBy("g1", "g2").agg(
        F.sum("n").alias("n_records"), F.bit_or("present").alias("present"), F.array(*[claim(s) for s in ranks]).alias("k0"),
        *[F.array(*[F.max(f"o{i}_{s}") for s in ranks]).alias(f"k{i}") for i in range(1, len(others) + 1)],
    ).where(F.col("n_records") >= least_records)

    def claims(c: str) -> Column:
        """The distinct values that the sources claim, each with the bits of its sources: v, e, bits, first (its most trusted source)."""
        each = F.zip_with(c, F.array(*[F.lit(s) for s in ranks]), lambda x, s: F.when(x.isNotNull(), F.struct(x["v"].alias("v"), *([x["e"].alias("e")] if c == "k0" else []), s.alias("s"))))
        given = F.filter(each, lambda x: x.isNotNull())
        bits = lambda x: F.aggregate(given, F.lit(0), lambda a, y: a + F.when(y["v"].eqNullSafe(x["v"]), F.lit(1).cast("int") * F.element_at(F.array(*[F.lit(1 << s) for s in ranks]), y["s"] + 1)).otherwise(0))
        marked = F.transform(given, lambda x: x.withField("bits", bits(x)))
        return F.filter(marked, lambda x: F.element_at(F.array(*[F.lit((1 << s) - 1) for s in ranks]), x["s"] + 1).bitwiseAND(x["bits"]) == 0)  # at its first source

    tags = range(len(others) + 1)  # 0 is the key field
    folded = cut_lineage(gathered.select("g1", "g2", "n_records", "present", *[claims(f"k{i}").alias(f"k{i}") for i in tags]))
    seen = F.flatten(F.array(*[F.transform(f"k{i}", lambda x: F.struct(F.lit(i).alias("field"), x["bits"].alias("claims"))) for i in tags]))  # noqa: B023
    counted = folded.select("present", F.explode(seen).alias("x")).groupBy("x.field", "x.claims", "present").agg(F.count(F.lit(1)).alias("n")).collect()  # fields times at most 3 ** SOURCE_LIMIT rows
    models = _models(counted, n_sources, set(range(len(fields) + 1)))
    spark = df.sparkSession
    out = folded
    for i in tags:
        table = [(q, [(c, o, models[i].posterior[c, q]) for (c, qq), o in sorted(models[i].log_odds.items()) if qq == q]) for q in sorted({q for _, q in models[i].log_odds})] if i in models else []
        odds = spark.createDataFrame(table, "__q int, __t array<struct<c:int,o:double,p:double>>")
        out = out.join(F.broadcast(odds), F.col("present") == F.col("__q"), "left")  # a pattern table, at most 2 ** SOURCE_LIMIT rows
        known = lambda x: F.element_at(F.filter("__t", lambda t: t["c"] == x["bits"]), 1)
        best = F.array_max(F.transform(f"k{i}", lambda x: F.struct(known(x)["o"].alias("o"), (-x["s"]).alias("s"), known(x)["p"].alias("p"), x.alias("x"))))
        out = out.withColumn(f"b{i}", F.when(F.size(f"k{i}") > 0, best)).drop("__q", "__t")
    out = out.select(
        "g1", "g2", "n_records", F.col("b0.x.v").alias(key_field), F.col("b0.p").alias("key_p"), (F.col("b0.x.s") == F.array_min(F.transform("k0", lambda x: x["s"]))).alias("key_first"),
        F.col("b0.x.e").alias(period_end), *[F.col(f"b{i}.x.v").alias(f) for i, f in enumerate(others, 1)],
    )
    if multi:
        out = out.join(true_values(rows, f"c_{multi}", n_sources, truth, f"{multi}_values"), ["g1", "g2"], "left")
    return out


def true_values(rows: DataFrame, field: str, n_sources: int, truth: float, out: str) -> DataFrame:
    """Every value of a multi-valued text field (trimmed, upper case) that its model judges true, by group as a sorted array.

    Here each source claims all values of its records. ``rows``: g1, g2, rank and the field; at least one non-blank value.
    """
    bits = F.bit_or(F.expr("shiftleft(1, rank)"))
    named = rows.select("g1", "g2", "rank", F.upper(F.trim(field)).alias("value")).where(F.col("value") != "")
    present = named.groupBy("g1", "g2").agg(bits.alias("present"))
    facts = cut_lineage(named.groupBy("g1", "g2", "value").agg(bits.alias("claims")).join(present, ["g1", "g2"]))
    counted = facts.groupBy("claims", "present").agg(F.count(F.lit(1)).alias("n")).collect()  # at most 3 ** SOURCE_LIMIT rows
    model = fit_two_sided({(r["claims"], r["present"]): r["n"] for r in counted}, n_sources)
    table = rows.sparkSession.createDataFrame([(c, q, p) for (c, q), p in sorted(model.posterior.items())], "claims int, present int, p double")
    true = facts.join(F.broadcast(table), ["claims", "present"]).where(F.col("p") >= truth)
    return true.groupBy("g1", "g2").agg(F.sort_array(F.collect_set("value")).alias(out))
