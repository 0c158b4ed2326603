"""Quantities recorded in different units: a conversion graph and inference of the unit of each value."""

from __future__ import annotations

from collections import deque

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import Window

from panelforge.operators.joins import settled
from panelforge.session import cut_lineage

#: Affine edges (from, to, a, b): value_to = a * value_from + b.
RETURN_UNITS: tuple[tuple[str, str, float, float], ...] = (
    ("bp", "percent", 0.01, 0.0),
    ("percent", "fraction", 0.01, 0.0),
    ("bp", "fraction", 0.0001, 0.0),
)
#: A unit graph is a vocabulary, not data; beyond this it is refused, which bounds what is broadcast.
UNIT_LIMIT = 500


def conversion_table(edges: tuple[tuple[str, str, float, float], ...], tolerance: float = 1e-9) -> dict[tuple[str, str], tuple[float, float, int]]:
    """Shortest compositions of the edges (both ways) between all pairs of connected units: (from, to) -> (a, b, hops).

    Every edge that closes a cycle must agree with the composition found without it, else ValueError: a graph with an inconsistent
    cycle has no well-defined conversion. Edges with a zero factor have no inverse and are refused.
    """
    steps: dict[str, dict[str, tuple[float, float]]] = {}
    for u, v, a, b in edges:
        if a == 0:
            raise ValueError(f"edge {u} -> {v} can't be inverted")
        steps.setdefault(u, {})[v] = (a, b)
        steps.setdefault(v, {}).setdefault(u, (1 / a, -b / a))
    if len(steps) > UNIT_LIMIT:
        raise ValueError("too many units")
    out: dict[tuple[str, str], tuple[float, float, int]] = {}
    for source in steps:
        out[source, source] = (1.0, 0.0, 0)
        queue = deque([source])
        while queue:
            at = queue.popleft()
            a0, b0, hops = out[source, at]
            for to, (a, b) in sorted(steps[at].items()):
                if (source, to) not in out:
                    out[source, to] = (a * a0, a * b0 + b, hops + 1)
                    queue.append(to)
        for at in [v for (u, v) in out if u == source]:
            a0, b0, _ = out[source, at]
            for to, (a, b) in steps[at].items():
                x, y, _ = out[source, to]
                if abs(a * a0 - x) > tolerance * max(1.0, abs(x)) or abs(a * b0 + b - y) > tolerance * max(1.0, abs(y)):
                    raise ValueError(f"the cycle {source} .. {at} -> {to} is inconsistent")
    return out


def conversion_frame(spark: SparkSession, edges: tuple[tuple[str, str, float, float], ...] = RETURN_UNITS) -> DataFrame:
    """The conversion table as rows (unit, target, a, b, hops)."""
    rows = [(u, v, a, b, h) for (u, v), (a, b, h) in sorted(conversion_table(edges).items())]
    return spark.createDataFrame(rows, "unit string, target string, a double, b double, hops int")


def convert(df: DataFrame, value: str, unit: str, target: str, out: str, edges: tuple[tuple[str, str, float, float], ...] = RETURN_UNITS) -> DataFrame:
    """``df`` with ``out`` = value in ``target`` units, by an equi-join on the source unit and the canonical target.

    A null or unknown unit gives null, as does a null value; rows are never dropped. ``out`` replaces a column of that name.
    """
    table = conversion_frame(df.sparkSession, edges).where(F.col("target") == target).select(F.col("unit").alias("__u"), F.col("a").alias("__a"), F.col("b").alias("__b"))
    joined = df.drop(out).join(F.broadcast(table), F.col(unit) == F.col("__u"), "left")
    return joined.withColumn(out, F.col(value).cast("double") * F.col("__a") + F.col("__b")).drop("__u", "__a", "__b")


#: Scales at which a value may be recorded: the power of ten by which it exceeds the fraction, and its node of the graph. Two decades lie between neighbours.
SCALES: tuple[tuple[int, str], ...] = ((0, "x1"), (2, "x100"), (4, "x10000"))
#: What a scale is in terms of the units: identity edges, so a value's unit and its fraction both follow from shortest compositions.
SCALE_EDGES: tuple[tuple[str, str, float, float], ...] = (("x1", "fraction", 1.0, 0.0), ("x100", "percent", 1.0, 0.0), ("x10000", "bp", 1.0, 0.0))
_BINS = 40  # per decade; neighbours are added, so values within about 9 % support each other
_SUPPORT = 9.0  # what a value that fits is worth against one that doesn't, in nats
_TEXT_WEIGHT = 0.5  # what a text says beside the habit of its source, from which it isn't independent; texts may be stale


def _size_prior(lg: Column, typical: Column) -> Column:
    """Log density, up to a constant, of log10 |x| for x from a t distribution with 4 degrees of freedom and scale ``typical``."""
    x = F.pow(F.lit(10.0), lg) / typical
    return lg * F.lit(2.302585092994046) - 2.5 * F.ln(1 + x * x / 4)


def _lg(i: int) -> Column:
    return F.log10(F.abs(F.col(f"v_{i}").cast("double")))


def _consensus(wide: DataFrame, n_fields: int, n_keys: int, weights: list[Column], typical: DataFrame | None = None) -> DataFrame:
    """For each group, the log10 size of each field's figure that the values support best, and its usual size: columns g0.., lf_0, t_0 ...

    The usual sizes come from ``wide`` (t_0 ...) or, where it no longer carries them, from ``typical``.

    ``weights``: what a value says for each of the three units. Values are first counted by bin of their own size, so what is tripled
    and shuffled by group is a few bins, however many sources report.
    """
    keys = [f"g{i}" for i in range(n_keys)]
    size = (lambda i: F.col(f"t_{i}")) if typical is None else (lambda i: F.lit(None).cast("double"))
    values = F.array(*[F.struct(F.lit(i).alias("f"), _lg(i).alias("lg"), size(i).alias("typical")) for i in range(n_fields)])
    long = wide.select(*keys, *[w.alias(f"w{k}") for k, w in enumerate(weights)], F.explode(values).alias("x")).where(F.col("x.lg").isNotNull())
    bins = long.groupBy(*keys, F.col("x.f").alias("f"), F.rint(F.col("x.lg") * _BINS).cast("int").alias("own")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("x.lg").alias("ls"), F.max("x.typical").alias("typical"), *[F.sum(f"w{k}").alias(f"w{k}") for k in range(3)]
    )
    if typical is not None:
        known = F.coalesce(*[F.when(F.col("f") == i, F.col(f"t_{i}")) for i in range(n_fields)])
        bins = bins.drop("typical").join(typical.select(*keys, *[f"t_{i}" for i in range(n_fields)]), keys).withColumn("typical", known)
    tripled = F.array(*[F.struct((F.col("own") - _BINS * step).alias("bin"), (F.col(f"w{k}") + _SUPPORT * F.col("n")).alias("w"), (F.col("ls") - step * F.col("n")).alias("ls")) for k, (step, _) in enumerate(SCALES)])
    cands = bins.select(*keys, "f", "typical", "n", F.explode(tripled).alias("c")).groupBy(*keys, "f", "typical", "c.bin").agg(F.sum("c.w").alias("w"), F.sum("c.ls").alias("ls"), F.sum("n").alias("n"))
    near = Window.partitionBy(*keys, "f").orderBy("bin").rangeBetween(-1, 1)
    smooth = cands.select(*keys, "f", "typical", F.sum("w").over(near).alias("ws"), (F.sum("ls").over(near) / F.sum("n").over(near)).alias("lf"))
    score = F.round(F.col("ws") + _size_prior(F.col("lf"), F.col("typical")), 6)
    best = smooth.groupBy(*keys, "f").agg(F.max(F.struct(score.alias("score"), F.col("lf"), F.col("typical"))).alias("b"))
    of = lambda i, c: F.max(F.when(F.col("f") == i, F.col(f"b.{c}")))
    return best.groupBy(*keys).agg(*[of(i, "lf").alias(f"lf_{i}") for i in range(n_fields)], *[of(i, "typical").alias(f"t_{i}") for i in range(n_fields)])


def _shares(counts: DataFrame, by: list[str], tag: str, base: list[float] | None = None) -> DataFrame:
    """Log shares of the scales among the values of each ``by``; relative to ``base`` and weighted down for texts."""
    c = counts.groupBy(*by).agg(*[F.sum(f"c{k}").alias(f"c{k}") for k, _ in SCALES])
    total = sum((F.col(f"c{k}") for k, _ in SCALES), F.lit(1.5))
    logs = [F.ln((F.col(f"c{k}") + 0.5) / total) for k, _ in SCALES]
    return settled(c.select(*by, *[(x if base is None else (x - o) * _TEXT_WEIGHT).alias(f"{tag}{k}") for x, (k, _), o in zip(logs, SCALES, base or [0.0] * 3)]))


def infer_scales(rows: DataFrame, group: list[str], src: str, block: list[Column], fields: dict[str, Column], keep: list[str], rounds: int = 2, texts: tuple[Column, ...] = ()) -> DataFrame:
    """The scale at which each value was recorded, told by the values and, weakly, by texts.

    ``rows``: one row a report, with several ``fields``; each comes with the usual size of its figure as a fraction. ``group``: what reports
    of the same figures share, such as table and date. ``src``: who reports. ``block``: a stretch of time within which a source
    mostly keeps its unit. ``texts``: unit names or notes beside the values; what each distinct text is worth is learned from the
    values that stand beside it, so a stale or unknown text says nothing. Sources report the same figure at different scales, so each value proposes
    three sizes; the size that a group supports best, given the usual scales of its sources in their blocks, of its texts, and the
    usual size of the figure, is taken, and each value's scale is the nearest. Bins of values, not values, are gathered by group, so
    a time or source with a third of all rows is no hot spot.

    Result, one row a row: the ``keep`` columns and, of each field, ``v_<i>`` (null for non-finite values and missing codes) and
    ``scale_<i>``, a node of the unit graph (null for a zero, without v or with a null in ``group``), i being the field's place. A null source is
    a source of its own; repeated rows come out as often; other columns are never looked at.
    """
    names, keys = list(fields), [f"g{i}" for i in range(len(group))]
    label = lambda c: F.nullif(F.lower(F.trim(c)), F.lit(""))
    told_by = [f"x{j}" for j in range(len(texts))]
    wide = rows.select(
        *[F.col(g).alias(k) for g, k in zip(group, keys)],
        F.coalesce(F.col(src).cast("string"), F.lit("")).alias("s"),
        *[b.alias(f"b{i}") for i, b in enumerate(block)],
        *[label(t).alias(x) for t, x in zip(texts, told_by)],
        *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)],
        *[measured(F.col(f)).alias(f"v_{i}") for i, f in enumerate(names)],
        *[t.cast("double").alias(f"t_{i}") for i, t in enumerate(fields.values())],
    )
    sized = wide.where(" AND ".join(f"{k} IS NOT NULL" for k in keys))
    wide = wide.drop(*[f"t_{i}" for i in range(len(names))])  # what joins carry is as recorded

    def stepped(joined: DataFrame) -> DataFrame:
        """With the place of each value's scale, 0 to 2, in a projection of its own, so that what uses it several times finds it computed."""
        size = lambda i: F.rint((_lg(i) - F.col(f"lf_{i}")) / 2)
        told = lambda i: (F.col(f"v_{i}") != 0) & F.col(f"lf_{i}").isNotNull()
        return joined.withColumns({f"st_{i}": F.when(told(i), F.when(size(i) <= 0, 0).when(size(i) >= len(SCALES) - 1, len(SCALES) - 1).otherwise(size(i).cast("int"))) for i in range(len(names))})

    place = ["s", *[f"b{i}" for i in range(len(block))]]
    figures = settled(_consensus(sized, len(names), len(keys), [F.lit(0.0)] * 3))
    for _ in range(rounds - 1):
        at = stepped(wide.join(figures, keys)).select(*place, *told_by, F.array(*[f"st_{i}" for i in range(len(names))]).alias("st"))
        each = at.select(*place, *told_by, *[F.size(F.filter("st", lambda x: x == k)).alias(f"n{k}") for k in range(len(SCALES))])  # noqa: B023
        counts = cut_lineage(each.groupBy(*place, *told_by).agg(*[F.sum(f"n{j}").cast("double").alias(f"c{k}") for j, (k, _) in enumerate(SCALES)]))
        whole = counts.agg(*[F.sum(f"c{k}") for k, _ in SCALES]).first()
        base = [float(np.log(((c or 0.0) + 0.5) / (sum(x or 0.0 for x in whole) + 1.5))) for c in whole]
        told = wide.join(_shares(counts, place, "u"), place)
        weights = [F.col(f"u{k}") for k, _ in SCALES]
        for x in told_by:
            told = told.join(_shares(counts.where(F.col(x).isNotNull()), [x], f"u_{x}_", base), x, "left")
            weights = [w + F.coalesce(F.col(f"u_{x}_{k}"), F.lit(0.0)) for w, (k, _) in zip(weights, SCALES)]
        figures = settled(_consensus(told, len(names), len(keys), weights, figures))
    placed = stepped(wide.join(figures, keys, "left"))
    node = lambda i: F.coalesce(*[F.when(F.col(f"st_{i}") == j, F.lit(u)) for j, (_, u) in enumerate(SCALES)])
    return placed.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *[F.col(f"v_{i}").cast("double").alias(f"v_{i}") for i in range(len(names))], *[node(i).alias(f"scale_{i}") for i in range(len(names))])


def reading_table(spark: SparkSession, target: str, named: tuple[str, ...], edges: tuple[tuple[str, str, float, float], ...] = (*RETURN_UNITS, *SCALE_EDGES)) -> DataFrame:
    """For every node that has a way to ``target``: ``__node``, ``unit`` (the name among ``named`` that it equals: an identity composition), and ``__a``, ``__b`` of its shortest composition to the target."""
    t = conversion_table(edges)
    same = lambda u: next((n for n in named if (u, n) in t and t[u, n][:2] == (1.0, 0.0)), None)
    rows = [(u, same(u), a, b) for (u, v), (a, b, _) in sorted(t.items()) if v == target]
    return spark.createDataFrame(rows, "__node string, unit string, __a double, __b double")


def infer_units(rows: DataFrame, group: list[str], src: str, block: list[Column], fields: dict[str, Column], keep: list[str], report: list[str] | None = None, rounds: int = 2, texts: tuple[Column, ...] = (), target: str = "fraction", out: str | None = None, zeros: bool = False) -> DataFrame:
    """The unit of each value as the conversion graph has it: the scale found by ``infer_scales`` is a node, and unit and conversion come by an equi-join on node and target.

    Result: the ``keep`` columns, field, v, unit ('fraction', 'percent', 'bp') for the fields in ``report`` (all by default), with ``out`` also
    the value in ``target`` units and ``recorded_otherwise``, whether the composition to the target isn't the identity. Cases: values
    that have no scale give no rows, else as there; with ``zeros`` a zero gives a row without unit, 0 in any unit (where the target has no offset).
    """
    names = list(fields)
    placed = infer_scales(rows, group, src, block, fields, keep, rounds, texts)
    found = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"v_{i}").alias("v"), F.col(f"scale_{i}").alias("node")) for i, f in enumerate(names) if report is None or f in report])
    told = F.col("__x.node").isNotNull()
    long = placed.select(*keep, F.explode(found).alias("__x")).where(told | (F.col("__x.v") == 0) if zeros else told)
    readings = F.broadcast(reading_table(rows.sparkSession, target, ("fraction", "percent", "bp")))  # a row a unit, at most UNIT_LIMIT
    read = long.join(readings, F.col("__x.node") == F.col("__node"), "left" if zeros else "inner")
    value = F.col("__x.v") * F.col("__a") + F.col("__b")
    more = [] if out is None else [(F.coalesce(value, F.col("__x.v")) if zeros else value).alias(out), ((F.col("__a") != 1.0) | (F.col("__b") != 0.0)).alias("recorded_otherwise")]
    return read.select(*keep, "__x.field", "__x.v", "unit", *more)


#: How the factor library writes a missing figure; a float holds them to about this much.
MISSING_CODES, CODE_WIDTH = (-99.99, -999.0), 0.002


def measured(c: Column) -> Column:
    """The number where it is finite and no missing code, else null."""
    told = F.abs(c) < F.lit(float("inf"))
    for x in MISSING_CODES:
        told = told & (F.abs(c - x) >= CODE_WIDTH)
    return F.when(told, c)


def is_missing_code(c: Column, codes: tuple[float, ...] = MISSING_CODES) -> Column:
    """True where a number is one of the missing codes, as float or double."""
    hit = F.lit(False)
    for x in codes:
        hit = hit | (F.abs(c.cast("double") - x) < CODE_WIDTH)
    return F.coalesce(hit, F.lit(False))
