"""Implausible readings: a hidden Markov model per series with normal, spike, stuck and out-of-range states."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelforge.functions.scalar import finite
from panelforge.operators.joins import settled
from panelforge.session import ship_package

NORMAL, SPIKE, STUCK, OUT = range(4)
STATES = ("normal", "spike", "stuck", "out_of_range")
#: What a series' own transitions are learned from besides its readings: this many steps of these rows (from each state, in the order of STATES).
TRANSITION = np.array([[0.9965, 0.002, 0.001, 0.0005], [0.9965, 0.002, 0.001, 0.0005], [0.1975, 0.002, 0.8, 0.0005], [0.9965, 0.002, 0.001, 0.0005]])
START = np.array([0.9965, 0.002, 0.001, 0.0005])
PRIOR_STEPS = 500.0
#: P(neither, one, both neighbouring periods hold the same value | state).
SAME_USUAL, SAME_STUCK = np.array([0.9969, 0.003, 0.0001]), np.array([0.02, 0.28, 0.70])
#: Normal readings: a normal bulk, and large moves from this many usual deviations up to where spikes begin, of this share to begin with.
LARGE_FROM, LARGE_SHARE = 3.0, 0.005
#: Spikes: their density falls as 1 / |z| over this many logs.
SPIKE_LOGS = np.log(200.0)
#: A series' scale is learned from the bulk of its normal readings besides this many readings at its source's scale for every series that the
#: source has: a source of one series learns its own, a part of a large source keeps the source's.
PRIOR_READINGS = 1.0
#: Rows that one forward-backward batch holds after padding.
BATCH_ROWS = 400_000


def emission(z: np.ndarray, same: np.ndarray, out: np.ndarray, large: np.ndarray | float = LARGE_SHARE, spike_at: float = 10.0) -> np.ndarray:
    """Densities (..., 4) of standardised readings, the number of equal neighbours (0..2) and out-of-range marks; ``large``: the share of large moves."""
    a = np.abs(z)
    bulk = np.exp(-0.5 * a**2) / np.sqrt(2 * np.pi)
    usual = (1 - large) * bulk + large * ((a > LARGE_FROM) & (a <= spike_at)) / (2 * (spike_at - LARGE_FROM)) + 1e-300
    spike = np.where(a > spike_at / 2, 1 / (2 * np.maximum(a, spike_at / 2) * SPIKE_LOGS), 1e-6)
    b = np.stack([usual * SAME_USUAL[same], spike * SAME_USUAL[same], (0.5 * usual + 0.5 * spike) * SAME_STUCK[same], np.full(z.shape, 1e-12)], axis=-1)
    b[out] = (1e-12, 1e-12, 1e-12, 1.0)
    return b


def forward_backward(b: np.ndarray, lengths: np.ndarray, transition: np.ndarray | None = None, counts: np.ndarray | None = None) -> np.ndarray:
    """Posteriors (T, S, K) of S padded chains at once; steps at or beyond a chain's length are 1 for every state.

    ``transition``: of all chains (K, K) or of each (S, K, K). Into ``counts`` (S, K, K) go the expected steps between states.
    """
    t, s, k = b.shape
    link = TRANSITION if transition is None else transition
    step = (lambda x: x @ link) if link.ndim == 2 else (lambda x: (x[:, None, :] @ link)[:, 0])
    back = (lambda x: x @ link.T) if link.ndim == 2 else (lambda x: (link @ x[:, :, None])[:, :, 0])
    b = np.where((np.arange(t)[:, None] < lengths[None, :])[:, :, None], b, 1.0)
    alpha = np.empty_like(b)
    x = START[None, :] * b[0]
    alpha[0] = x / x.sum(1, keepdims=True)
    for i in range(1, t):
        x = step(alpha[i - 1]) * b[i]
        alpha[i] = x / x.sum(1, keepdims=True)
    beta = np.ones((s, k))
    for i in range(t - 2, -1, -1):
        ahead = b[i + 1] * beta
        if counts is not None:
            pairs = alpha[i][:, :, None] * link * ahead[:, None, :]
            pairs *= ((i + 1 < lengths) / pairs.sum((1, 2)))[:, None, None]
            counts += pairs
        beta = back(ahead)
        beta /= beta.sum(1, keepdims=True)
        x = alpha[i] * beta
        alpha[i] = x / x.sum(1, keepdims=True)
    return alpha


def run_evidence(series: np.ndarray, period: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows sorted by (series, period): how many neighbouring recorded periods hold the same non-zero value, and the length of the run of such periods."""
    n = len(series)
    fresh = np.ones(n, bool)
    fresh[1:] = (series[1:] != series[:-1]) | (period[1:] != period[:-1])
    rank = np.cumsum(fresh)
    first = np.ones(n, bool)
    first[1:] = series[1:] != series[:-1]
    rank = rank + np.cumsum(first)  # a jump of two between series
    order = np.lexsort((rank, value))
    v, r = value[order], rank[order]
    linked = np.zeros(n, bool)
    linked[1:] = (v[1:] == v[:-1]) & (r[1:] == r[:-1] + 1) & (v[1:] != 0)
    run = np.cumsum(~linked)
    length = np.bincount(run)[run]
    same = linked.astype(np.int8)
    same[:-1] += linked[1:]
    out_same, out_len = np.empty(n, np.int8), np.empty(n, np.int64)
    out_same[order], out_len[order] = same, length
    return out_same, out_len


def learn(z: np.ndarray, same: np.ndarray, out: np.ndarray, sizes: np.ndarray, prior: np.ndarray, rounds: int, spike_at: float) -> np.ndarray:
    """Posteriors (T, S, 4) of S padded chains under their own parameters: each round re-estimates every chain's transitions, share of large moves and scale from expected counts.

    ``prior``: readings that the source's scale counts for.
    """
    inside = (np.arange(len(z))[:, None] < sizes[None, :]).astype(float)
    scale, large, link = np.ones(z.shape[1]), np.full(z.shape[1], LARGE_SHARE), TRANSITION
    for r in range(rounds + 1):
        own = z / scale
        b = emission(own, same, out, large, spike_at)
        counts = np.zeros((z.shape[1], 4, 4)) if r < rounds else None
        post = forward_backward(b, sizes, link, counts)
        if counts is None:
            return post
        usual, a = post[:, :, NORMAL] * inside, np.abs(own)
        far = large / (2 * (spike_at - LARGE_FROM)) * ((a > LARGE_FROM) & (a <= spike_at))
        moves = usual * far / (far + (1 - large) * np.exp(-0.5 * a**2) / np.sqrt(2 * np.pi) + 1e-300)
        bulk = usual - moves
        scale = np.sqrt(((bulk * own**2).sum(0) * scale**2 + prior) / (bulk.sum(0) + prior))
        large = (moves.sum(0) + PRIOR_STEPS * LARGE_SHARE) / (usual.sum(0) + PRIOR_STEPS)
        link = (counts + PRIOR_STEPS * TRANSITION) / (counts.sum(2, keepdims=True) + PRIOR_STEPS)
    raise AssertionError


def score_series(series: np.ndarray, period: np.ndarray, value: np.ndarray, center: np.ndarray, scale: np.ndarray, of_source: np.ndarray, floor: float, rounds: int = 2, spike_at: float = 10.0) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors (n, 4) and run lengths of complete series, rows sorted by (series, period, value); ``of_source``: points of the row's source."""
    z, out = (value - center) / scale, value < floor
    same, length = run_evidence(series, period, value)
    starts = np.flatnonzero(np.r_[True, series[1:] != series[:-1]])
    sizes = np.diff(np.r_[starts, len(series)])
    post = np.empty((len(series), 4))
    by_size = np.argsort(-sizes, kind="stable")
    i = 0
    while i < len(by_size):
        longest = sizes[by_size[i]]
        j = min(len(by_size), i + max(1, BATCH_ROWS // int(longest)))
        chosen = by_size[i:j]
        steps = np.arange(longest)[:, None]
        at = np.minimum(starts[chosen][None, :] + steps, len(series) - 1)
        p = learn(z[at], same[at], out[at], sizes[chosen], PRIOR_READINGS * np.maximum(1.0, of_source[starts[chosen]] / sizes[chosen]), rounds, spike_at)
        inside = steps < sizes[chosen][None, :]
        post[at[inside]] = p[inside]
        i = j
    return post, length


def _score_batches(floor: float, rounds: int, spike_at: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["tbl", "series", "period", "v", "center", "scale", "min_run", "of_source"]
        held: list[list[np.ndarray]] = []

        def flush(cols: list[np.ndarray]) -> pa.RecordBatch:
            tbl, series, period, v, center, scale, min_run, of_source = cols
            key = np.cumsum(np.r_[True, (series[1:] != series[:-1]) | (tbl[1:] != tbl[:-1])])
            post, length = score_series(key, period, v, center, scale, of_source, floor, rounds, spike_at)
            best = post.argmax(1)
            # an exact check of the run's length follows the posterior
            flag = np.where(v < floor, OUT, np.where((best == STUCK) & (min_run > 0) & (length >= min_run), STUCK, np.where(best == SPIKE, SPIKE, NORMAL)))
            keep = flag != NORMAL
            sure = post[np.arange(len(v)), flag]
            return pa.RecordBatch.from_arrays(
                [pa.array(tbl[keep]), pa.array(series[keep]), pa.array(period[keep]), pa.array(v[keep]), pa.array(flag[keep].astype(np.int32)), pa.array(sure[keep])],
                names=["tbl", "series", "period", "v", "flag", "p"],
            )

        n = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            fresh = [batch.column(name).to_numpy(zero_copy_only=False) for name in names]
            held.append(fresh)
            n += batch.num_rows
            # arrays are joined once a flush, not once a batch, however long one series is
            if n >= BATCH_ROWS and (held[0][1][0] != fresh[1][-1] or held[0][0][0] != fresh[0][-1]):
                cols = [np.concatenate(x) for x in zip(*held)]
                cut = np.flatnonzero((cols[1] != cols[1][-1]) | (cols[0] != cols[0][-1]))[-1] + 1
                held, n = [[c[cut:] for c in cols]], len(cols[0]) - cut
                yield flush([c[:cut] for c in cols])
        if held:
            yield flush([np.concatenate(x) for x in zip(*held)])

    return run


def usual_variation(points: DataFrame) -> DataFrame:
    """Centre and scale of each (tbl, source): the median, and the wider of the inter-quartile and the 10-90 % spread as normal deviations.

    The 10-90 % spread, which a source with a long normal tail needs, takes 15 points; scales of small sources lean to the usual scale of their table (by their logs, with the weight of ten points); none counts as less than a tenth of it.
    """
    q = points.groupBy("tbl", "source").agg(F.percentile_approx("v", F.array(*[F.lit(x) for x in (0.1, 0.25, 0.5, 0.75, 0.9)]), F.lit(1000)).alias("q"), F.count(F.lit(1)).alias("n"))
    mid, far = (F.col("q")[3] - F.col("q")[1]) / 1.349, (F.col("q")[4] - F.col("q")[0]) / 2.563
    own = q.select("tbl", "source", F.col("q")[2].alias("center"), F.when(F.col("n") >= 15, F.greatest(mid, far)).otherwise(mid).alias("s"), "n")
    typical = own.groupBy("tbl").agg(F.percentile_approx("s", F.lit(0.5), F.lit(1000)).alias("ts"))
    both = own.join(F.broadcast(typical), "tbl")
    own_log = F.ln(F.greatest("s", F.col("ts") / 10, F.lit(1e-9)))
    lean = (own_log * F.col("n") + F.ln(F.greatest("ts", F.lit(1e-9))) * 10) / (F.col("n") + 10)
    return both.select("tbl", "source", "center", F.exp(lean).alias("scale"), F.col("n").alias("of_source"))


def flag_readings(readings: DataFrame, floor: float = -1.0, rounds: int = 2, spike_at: float = 10.0) -> DataFrame:
    """Flags on readings, each judged by what is normal for its source.

    ``readings``: tbl int (a few codes), id, series long, source (any), period int (day or month number), v, min_run int (periods of a
    stuck run, 0: none). The distinct (series, period, value) points, bounded by the calendar and the values sent for a day, are
    standardised by their source and sorted by series. Each task runs a hidden Markov model over complete series in batches; in ``rounds`` rounds
    of re-estimation every series' transitions, share of large moves and scale are learned from its own expected counts, with its source as prior.
    Spikes begin at ``spike_at`` usual deviations. Flags go back to every reading that has such a point. A last exact check admits
    stuck runs of ``min_run`` or more recorded periods only.

    Result: tbl, id, flag ('spike', 'stuck', 'out_of_range'), p (posterior), flagged readings only. Cases: null or non-finite values are never
    flagged; without a series or source only the bound ``floor`` judges; a null period takes no part in runs; repeats are flagged
    alike; an empty table gives no rows.
    """
    ship_package(readings.sparkSession)
    rows = readings.withColumn("v", finite(F.col("v"))).where(F.col("v").isNotNull()).withColumn("period", F.coalesce(F.col("period"), F.lit(2**31 - 1)))
    judged = rows.where(F.col("series").isNotNull() & F.col("source").isNotNull())
    points = judged.groupBy("tbl", "series", "period", "v").agg(F.max("source").alias("source"), F.max("min_run").alias("min_run"))
    usual = settled(usual_variation(points.where(F.col("v") >= floor)).withColumnsRenamed({"tbl": "__t", "source": "__s"}))  # one row a source
    scaled = points.join(usual, (F.col("tbl") == F.col("__t")) & (F.col("source") == F.col("__s")))
    wide = scaled.select("tbl", "series", "period", "v", "center", "scale", "min_run", "of_source").repartition("tbl", "series").sortWithinPartitions("tbl", "series", "period", "v")
    flags = wide.mapInArrow(_score_batches(floor, rounds, spike_at), "tbl int, series long, period int, v double, flag int, p double")
    named = F.element_at(F.array(*[F.lit(s) for s in STATES]), F.col("flag") + 1)
    hit = judged.join(flags, ["tbl", "series", "period", "v"]).select("tbl", "id", named.alias("flag"), "p")
    bound = rows.where((F.col("series").isNull() | F.col("source").isNull()) & (F.col("v") < floor)).select("tbl", "id", F.lit("out_of_range").alias("flag"), F.lit(1.0).alias("p"))
    return hit.unionByName(bound)
