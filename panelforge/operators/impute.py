"""Missing cells of a panel filled by chained equations, with a mark on each filled cell."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from panelforge.functions.scalar import finite
from panelforge.operators.joins import settled
from panelforge.session import cut_lineage, ship_package

#: A category has at most this many codes: they are a declared vocabulary.
CODE_LIMIT = 1_000
#: Codes times months: a vocabulary times a calendar. Beyond it the panel is refused, so what travels to every task has a proven bound.
CELL_LIMIT = 200_000
RIDGE = 1e-8


def measured(c: Column, lo: float, hi: float) -> Column:
    """The number where it is finite and strictly between the bounds of its quantity, else null: stand-ins lie outside."""
    d = c.cast("double")
    return F.when((d > max(lo, -1.7e308)) & (d < min(hi, 1.7e308)), d)


def _uniform(h: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in (0, 1) fixed by 64-bit hashes and a salt (splitmix64 steps)."""
    x = h.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2.0**53 + 2.0**-54


def _normal(h: np.ndarray, salt: int) -> np.ndarray:
    return np.sqrt(-2 * np.log(_uniform(h, 2 * salt))) * np.cos(2 * np.pi * _uniform(h, 2 * salt + 1))


@dataclass
class _Panel:
    """What every task knows: names, bounds, means and the sums of each code and month; and what the rounds have fitted so far."""

    fields: list[str]  # with bounds, filled in the result
    others: list[str]  # predictors, filled within the chain only
    bounds: np.ndarray  # (fields, 2)
    means: np.ndarray  # (fields + others)
    months: np.ndarray  # sorted ordinals of the months that have cells
    cell_sum: np.ndarray  # (codes, months, fields)
    cell_n: np.ndarray
    seed: int
    rounds: list[list[tuple[np.ndarray, float] | None]]

    @property
    def names(self) -> list[str]:
        return [*self.fields, *self.others]

    def columns(self) -> list[str]:
        """Columns of a row that the chain reads, after its keys."""
        return ["h", "code", "month", *[f"y_{i}" for i in range(len(self.names))], *[f"{t}_{i}" for t in ("es", "en") for i in range(len(self.fields))]]

    def read(self, b: pa.RecordBatch) -> dict[str, np.ndarray]:
        get = lambda n: b.column(n).to_numpy(zero_copy_only=False)
        k = len(self.fields)
        y = np.stack([get(f"y_{i}").astype(float) for i in range(len(self.names))], 1)
        own = np.where(np.isnan(y[:, :k]), 0.0, y[:, :k])
        n = np.stack([get(f"en_{i}").astype(float) for i in range(k)], 1) - ~np.isnan(y[:, :k])
        total = np.stack([get(f"es_{i}").astype(float) for i in range(k)], 1) - own
        with np.errstate(all="ignore"):
            by_entity = np.where(n > 0, total / n, np.nan)
        fills = [get(c).astype(int) for c in b.schema.names if c.startswith("fill_")]
        month = get("month").astype(int)
        at = np.searchsorted(self.months, month)
        place = np.where((at < len(self.months)) & (np.append(self.months, -2)[at] == month), at, -1)
        return {"y": y, "entity": by_entity, "h": get("h").astype(np.int64), "code": get("code").astype(int), "month": place, "fills": np.stack(fills, 1) if fills else np.zeros((len(y), 0), int)}

    def codes(self, d: dict, r: int) -> np.ndarray:
        """Each row's code in round ``r``: its own, else the fill of that round; -1 for none."""
        return np.where(d["code"] >= 0, d["code"], d["fills"][:, min(r, d["fills"].shape[1] - 1)])

    def of_cell(self, d: dict, code: np.ndarray) -> np.ndarray:
        """Means over the other rows of the same code and month, else of all rows."""
        k = len(self.fields)
        known, own = (code >= 0) & (d["month"] >= 0), d["y"][:, :k]
        at = (np.maximum(code, 0), np.maximum(d["month"], 0))
        counted = ~np.isnan(own) & (d["code"] >= 0)[:, None]  # rows with a code of their own are in the sums
        n = np.where(known[:, None], self.cell_n[at] - counted, 0)
        total = self.cell_sum[at] - np.where(counted, own, 0.0)
        with np.errstate(all="ignore"):
            return np.where(n > 0, total / n, self.means[:k])

    def design(self, d: dict, x: np.ndarray, code: np.ndarray, near: np.ndarray, i: int) -> np.ndarray:
        """Regressors of variable ``i``: constant, code, the means of its entity and of its cell (fields only), and all other variables."""
        dummies = (code[:, None] == np.arange(1, len(self.cell_n))).astype(float)
        means = [d["entity0"][:, i], near[:, i]] if i < len(self.fields) else []
        return np.column_stack([np.ones(len(x)), dummies, *means, np.delete(x, i, 1)])

    def state(self, d: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Filled variables, codes and cell means after the rounds fitted so far."""
        k, gap = len(self.fields), np.isnan(d["y"])
        code = self.codes(d, 0)
        near = self.of_cell(d, code)
        d["entity0"] = np.where(np.isnan(d["entity"]), near, d["entity"])
        x = np.where(gap, np.column_stack([d["entity0"], np.tile(self.means[k:], (len(gap), 1))]), d["y"])
        for r, models in enumerate(self.rounds):
            fresh = x.copy()
            for i, model in enumerate(models):
                if model is None:
                    continue
                rows = np.flatnonzero(gap[:, i])
                part = {n: v[rows] for n, v in d.items()}
                guess = self.design(part, x[rows], code[rows], near[rows], i) @ model[0]
                drawn = guess + model[1] * _normal(d["h"][rows], 64 * self.seed + i)
                if i < k:  # a draw beyond the bounds falls back to the prediction, and that to the entity's mean
                    lo, hi = self.bounds[i]
                    drawn = np.where((drawn > lo) & (drawn < hi), drawn, np.where((guess > lo) & (guess < hi), guess, d["entity0"][rows, i]))
                fresh[rows, i] = drawn
            x, code = fresh, self.codes(d, r + 1)
            near = self.of_cell(d, code)
        return x, code, near


def _sums(panel: _Panel):
    """Partial X'X, X'y, y'y of every variable's regression and the counts, sums and squares of every code, one row each a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            d = panel.read(b)
            x, code, near = panel.state(d)
            for i in range(len(panel.names)):
                rows = np.flatnonzero(~np.isnan(d["y"][:, i]))
                part = {n: v[rows] for n, v in d.items()}
                a = np.column_stack([panel.design(part, x[rows], code[rows], near[rows], i), d["y"][rows, i]])
                total[i] = total.get(i, 0.0) + a.T @ a
            rows = np.flatnonzero(d["code"] >= 0)
            one = (d["code"][rows, None] == np.arange(len(panel.cell_n))).astype(float)
            total[-1] = total.get(-1, 0.0) + one.T @ np.column_stack([np.ones(len(rows)), x[rows], x[rows] ** 2])
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([m.ravel().tolist() for m in total.values()], pa.list_(pa.float64()))], names=["i", "m"])

    return run


def _fit(rows: DataFrame, panel: _Panel) -> tuple[list[tuple[np.ndarray, float] | None], np.ndarray]:
    """Least squares of each variable (coefficients, residual deviation) and a Gaussian of every code (log share, means, deviations)."""
    n_codes, n_vars = len(panel.cell_n), len(panel.names)
    parts = rows.mapInArrow(_sums(panel), "i int, m array<double>")
    sums = parts.select("i", F.posexplode("m").alias("k", "x")).groupBy("i", "k").agg(F.sum("x").alias("x")).collect()  # variables * (codes + variables) ** 2 numbers
    flat: dict[int, dict[int, float]] = {}
    for r in sums:
        flat.setdefault(r["i"], {})[r["k"]] = r["x"]
    models: list[tuple[np.ndarray, float] | None] = []
    for i in range(n_vars):
        v = np.array([flat[i][k] for k in range(len(flat[i]))]) if i in flat else np.zeros(0)
        m = v.reshape(int(round(len(v) ** 0.5)), -1) if len(v) else np.zeros((0, 0))
        if not len(m) or m[0, 0] == 0:
            models.append(None)
            continue
        xx, xy, yy = m[:-1, :-1], m[:-1, -1], m[-1, -1]
        beta = np.linalg.lstsq(xx + RIDGE * np.diag(np.maximum(np.diag(xx), 1e-12)), xy, rcond=None)[0]
        sse = max(0.0, yy - 2 * beta @ xy + beta @ xx @ beta)
        models.append((beta, float(np.sqrt(sse / max(1.0, m[0, 0] - len(beta))))))
    c = np.array([flat[-1][k] for k in range(n_codes * (1 + 2 * n_vars))]).reshape(n_codes, -1) if -1 in flat else np.zeros((n_codes, 1 + 2 * n_vars))
    n = np.maximum(c[:, :1], 1.0)
    mean = c[:, 1 : 1 + n_vars] / n
    sd = np.sqrt(np.maximum(c[:, 1 + n_vars :] / n - mean**2, 1e-12))
    share = (c[:, 0] + 1e-6) / (c[:, 0].sum() + 1e-6 * n_codes)
    return models, np.column_stack([np.log(share), mean, np.maximum(sd, 1e-6), c[:, 0]])


def _likelihoods(panel: _Panel, classes: np.ndarray):
    """For rows without a code of their own, the Gaussian log likelihood of their filled variables under every code, summed by entity and task."""
    n_vars = len(panel.names)
    mean, sd, live = classes[:, 1 : 1 + n_vars], classes[:, 1 + n_vars : 1 + 2 * n_vars], classes[:, -1] > 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, _, _ = panel.state(panel.read(b))
            ll = np.stack([-0.5 * (((x - m) / d) ** 2).sum(1) - np.log(d).sum() if on else np.full(len(x), -1e6) for m, d, on in zip(mean, sd, live)], 1)
            yield pa.RecordBatch.from_arrays([b.column("entity"), b.column("lone"), *[pa.array(ll[:, c]) for c in range(ll.shape[1])]], names=["entity", "lone", *[f"l{c}" for c in range(ll.shape[1])]])

    return run


def impute_chained(
    df: DataFrame,
    row: str,
    entity: str,
    time: str,
    fields: dict[str, tuple[float, float]],
    category: str,
    codes: tuple[str, ...],
    predictors: tuple[str, ...] = (),
    iterations: int = 3,
    seed: int = 7,
) -> DataFrame:
    """Fill numeric ``fields`` and one ``category`` by chained equations.

    A numeric cell lacks a value where it is null, not finite or outside its bounds; a category cell where its trimmed text is none of
    ``codes``. Every round refits, on the cells as filled before, a regression of each field and each predictor and a classifier of
    the category. Regressors are the code, the field's mean over the entity's other rows and over the other rows of the same code and
    month, and all other variables. The classifier weighs an entity's own codes, each of which errs as often as
    entities contradict themselves, and the filled numbers of its rows without a code. A filled number is the prediction plus a normal draw of the residual deviation, a filled code a draw by the posterior (one
    for an entity, or for a row without one), fixed by row or entity; numbers stay within their bounds. So the spread of fields survives.

    The sums behind the means come from one pass; a round is one pass of partial cross products and one over the rows without code.

    Result: row, entity, time (null entity or time kept), each field and the category filled, and ``<name>_filled`` marks. Every row comes
    out once. Cases: a field without any measured value stays null and unmarked, as does the category without any code; rows
    repeated in the input come out as often; an empty table gives no rows; other columns are never looked at.
    """
    spark = df.sparkSession
    ship_package(spark)
    if len(codes) > CODE_LIMIT:
        raise ValueError("the category has more codes than CODE_LIMIT")
    names, every = list(fields), [*fields, *predictors]
    k, n_codes = len(names), len(codes)
    text = F.trim(F.col(category))
    place = F.coalesce(*[F.when(text == c, F.lit(i)) for i, c in enumerate(codes)]) if codes else F.lit(None).cast("int")
    month = (F.year(time) * 12 + F.month(time)).cast("int")
    numbers = [measured(F.col(f), lo, hi) for f, (lo, hi) in fields.items()] + [finite(F.col(p)) for p in predictors]
    base = df.select(F.col(row).alias("row"), F.col(entity).alias("entity"), F.col(time).alias("time"), F.coalesce(place, F.lit(-1)).alias("code"), F.coalesce(month, F.lit(-1)).alias("month"), *[c.alias(f"y_{i}") for i, c in enumerate(numbers)])
    totals = [x for i in range(len(every)) for x in (F.sum(f"y_{i}").alias(f"s_{i}"), F.count(f"y_{i}").alias(f"n_{i}"))]
    # one pass: sums by entity and code, by code and month, and over all
    grouped = base.groupingSets([["entity", "code"], ["code", "month"], []], "entity", "code", "month").agg(F.grouping_id("entity", "code", "month").alias("gid"), F.count(F.lit(1)).alias("n"), *totals)
    sums = cut_lineage(grouped)
    whole = sums.where("gid = 7").first()
    means = np.array([whole[f"s_{i}"] / whole[f"n_{i}"] if whole and whole[f"n_{i}"] else 0.0 for i in range(len(every))])
    cells = sums.where("gid = 4 AND code >= 0 AND month >= 0").select("code", "month", *[f"{t}_{i}" for t in "sn" for i in range(k)]).limit(CELL_LIMIT + 1).collect()
    months = {m: j for j, m in enumerate(sorted({r["month"] for r in cells}))}
    if len(cells) > CELL_LIMIT or len(months) * n_codes > CELL_LIMIT:
        raise ValueError("the panel has more codes and months than CELL_LIMIT")
    cell_sum, cell_n = np.zeros((n_codes, max(1, len(months)), k)), np.zeros((n_codes, max(1, len(months)), k))
    for r in cells:
        for i in range(k):
            cell_sum[r["code"], months[r["month"]], i], cell_n[r["code"], months[r["month"]], i] = r[f"s_{i}"] or 0.0, r[f"n_{i}"]
    panel = _Panel(names, list(predictors), np.array(list(fields.values())).reshape(k, 2), means, np.array(sorted(months), int), cell_sum, cell_n, seed, [])
    known = [(i, name) for i, name in enumerate(names) if whole and whole[f"n_{i}"]]

    votes = F.array(*[F.coalesce(F.sum(F.when(F.col("code") == c, F.col("n"))), F.lit(0)) for c in range(n_codes)])
    own = F.max(F.when(F.col("code") >= 0, F.struct("n", (-F.col("code")).alias("c"))))
    about = settled(sums.where("gid = 1 AND entity IS NOT NULL").groupBy(F.col("entity").alias("__e")).agg(
        *[F.sum(f"{t}_{i}").cast("double").alias(f"e{t}_{i}") for i in range(k) for t in "sn"], F.coalesce(-own["c"], F.lit(-1)).alias("fill_0"), votes.alias("votes")
    ))
    tally = about.agg(F.sum(F.array_max("votes")).alias("most"), F.sum(F.aggregate("votes", F.lit(0).cast("long"), lambda a, v: a + v)).alias("all")).first()
    err = ((tally["all"] or 0) - (tally["most"] or 0) + 0.5) / ((tally["all"] or 0) + 1.0)
    vote = float(np.log((1 - err) * max(1, n_codes - 1) / err))  # nats that an own code says for itself
    joined = base.join(about.drop("votes"), F.col("entity") == F.col("__e"), "left").select(
        "row", "entity", "time", F.when(F.col("entity").isNull(), F.col("row")).alias("lone"), F.xxhash64(F.lit(seed), "row").alias("h"), "code",
        "month", *[f"y_{i}" for i in range(len(every))],
        *[F.coalesce(f"e{t}_{i}", F.when(F.lit(t == "n"), 0.0), F.lit(0.0)).alias(f"e{t}_{i}") for i in range(k) for t in "sn"], F.coalesce("fill_0", F.lit(-1)).alias("fill_0"),
    )
    start = cut_lineage(joined)
    state, any_code = start, False
    for r in range(max(1, iterations)):
        models, classes = _fit(state.select(*panel.columns(), *[c for c in state.columns if c.startswith("fill_")]), panel)
        panel.rounds = [*panel.rounds, models]
        any_code = bool((classes[:, -1] > 0).any()) if n_codes else False
        if not any_code:
            break
        bare = state.where("code < 0")
        evidence = bare.select("entity", "lone", *panel.columns(), *[c for c in state.columns if c.startswith("fill_")]).mapInArrow(
            _likelihoods(panel, classes), f"entity {df.schema[entity].dataType.simpleString()}, lone {df.schema[row].dataType.simpleString()}, " + ", ".join(f"l{c} double" for c in range(n_codes))
        )
        by_entity = evidence.groupBy("entity", "lone").agg(*[F.sum(f"l{c}").alias(f"l{c}") for c in range(n_codes)])
        told = by_entity.join(about.select("__e", "votes"), F.col("entity") == F.col("__e"), "left")
        logs = F.array(*[F.coalesce(F.get("votes", F.lit(c)), F.lit(0)) * vote + float(classes[c, 0]) + F.col(f"l{c}") for c in range(n_codes)])
        weight = F.transform("w", lambda v: F.exp(v - F.array_max("w")))
        u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(r), "entity", "lone"), 11).cast("double") + 0.5) / float(2**53)
        running = told.withColumn("w", logs).withColumn("w", weight).withColumn("u", u * F.aggregate("w", F.lit(0.0), lambda a, v: a + v))
        drawn = F.size(F.filter(F.transform("w", lambda v, i: F.aggregate(F.slice("w", 1, i + 1), F.lit(0.0), lambda a, y: a + y)), lambda c: c < F.col("u")))
        fills = settled(running.select(F.col("entity").alias("__fe"), F.col("lone").alias("__fl"), F.least(drawn, F.lit(n_codes - 1)).alias(f"fill_{r + 1}")))
        # only rows without a code need one; the others get keys of their own, so no entity gathers them
        asks = F.when(F.col("code") < 0, F.xxhash64("entity", "lone")).otherwise(F.xxhash64("row", "h"))
        hit = (asks == F.col("__fh")) & F.col("entity").eqNullSafe(F.col("__fe")) & F.col("lone").eqNullSafe(F.col("__fl"))
        keyed = fills.withColumn("__fh", F.xxhash64("__fe", "__fl"))
        state = state.join(keyed, hit & (F.col("code") < 0), "left").drop("__fh", "__fe", "__fl").withColumn(f"fill_{r + 1}", F.coalesce(f"fill_{r + 1}", F.lit(-1)))

    spelled, live = np.array([*codes, None], dtype=object), [i for i, _ in known]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = panel.read(b)
            x, code, _ = panel.state(d)
            gap = np.isnan(d["y"])
            cols = [b.column("row"), b.column("entity"), b.column("time")]
            for i in range(k):
                cols += [pa.array(x[:, i] if i in live else np.full(len(x), np.nan), from_pandas=True), pa.array(gap[:, i] & (i in live))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(spelled[code].tolist(), pa.string()), pa.array((d["code"] < 0) & (code >= 0))], names=["row", "entity", "time", *[c for i in range(k) for c in (f"x_{i}", f"m_{i}")], "cat", "m_cat"])

    kinds = [f"{a} {df.schema[c].dataType.simpleString()}" for a, c in (("row", row), ("entity", entity), ("time", time))]
    out = state.select("row", "entity", "time", *panel.columns(), *[c for c in state.columns if c.startswith("fill_")]).mapInArrow(finish, ", ".join([*kinds, *[c for i in range(k) for c in (f"x_{i} double", f"m_{i} boolean")], "cat string, m_cat boolean"]))
    return out.select(F.col("row").alias(row), F.col("entity").alias(entity), F.col("time").alias(time), *[c for i, f in enumerate(names) for c in (F.col(f"x_{i}").alias(f), F.col(f"m_{i}").alias(f"{f}_filled"))], F.col("cat").alias(category), F.col("m_cat").alias(f"{category}_filled"))


def filled_cells(imputed: DataFrame, row: str, names: list[str]) -> DataFrame:
    """One row (row, field) for each cell that was filled."""
    marks = F.array(*[F.when(F.col(f"{n}_filled") & F.col(n).isNotNull(), F.lit(n)) for n in names])
    return imputed.select(row, F.explode(marks).alias("field")).where(F.col("field").isNotNull())
