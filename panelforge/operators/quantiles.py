"""Exact quantiles of large groups without gathering a group's values: brackets narrow by sketches, then only what lies inside a bracket is fetched."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

#: Groups and values that may reach the driver. A bracket that holds more values is narrowed again.
GROUP_LIMIT, FETCH_LIMIT = 2_000, 500_000
#: Half the width of a first bracket, as a share of the group, and the sketches' accuracy.
HALF_WIDTH, ACCURACY = 0.002, 10_000


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: tuple[float, ...], out: str = "q") -> DataFrame:
    """Each group's quantiles of a finite number, interpolated between neighbours: the keys and an array in the order of ``probs``.

    A first pass sketches where each quantile lies; a second counts what lies below and inside these brackets. Brackets of more than
    FETCH_LIMIT values in all are narrowed by further sketches of what lies inside; then their distinct values with counts are fetched. Groups are few
    (more than GROUP_LIMIT are refused), their sizes unbounded. Cases: null values don't count; a group without values has nulls; null keys
    are a group; ties and repeats count as often as they occur; an empty table gives no rows.
    """
    spark = df.sparkSession
    v = F.col(value).cast("double")
    rows = df.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], v.alias("v"))
    names = [f"k{i}" for i in range(len(keys))]
    around = [min(1.0, max(0.0, p + s * HALF_WIDTH)) for p in probs for s in (-1, 1)]
    first = rows.groupBy(*names).agg(F.count("v").alias("n"), F.percentile_approx("v", F.array(*[F.lit(p) for p in around]), F.lit(ACCURACY)).alias("b")).limit(GROUP_LIMIT + 1).collect()
    if len(first) > GROUP_LIMIT:
        raise ValueError("more groups than GROUP_LIMIT")
    jobs = []  # group, place of the probability, ranks wanted, bracket
    for g, r in enumerate(first):
        for i, p in enumerate(probs):
            if r["n"]:
                at = p * (r["n"] - 1)
                jobs.append({"g": g, "i": i, "low": math.floor(at), "high": math.ceil(at), "lo": r["b"][2 * i], "hi": r["b"][2 * i + 1]})
    found: dict[tuple[int, int], float] = {}
    while jobs:
        table = spark.createDataFrame([(*[first[j["g"]][k] for k in names], j["g"], j["i"], j["lo"], j["hi"]) for j in jobs], StructType([*[rows.schema[k] for k in names], *[StructField(c, t) for c, t in (("g", IntegerType()), ("i", IntegerType()), ("lo", DoubleType()), ("hi", DoubleType()))]]))
        hit = F.lit(True)
        for k in names:
            hit = hit & rows[k].eqNullSafe(table[k])
        near = rows.where("v IS NOT NULL").join(F.broadcast(table), hit).select("g", "i", "lo", "hi", "v")  # at most GROUP_LIMIT times the probabilities
        inside = F.col("v").between(F.col("lo"), F.col("hi"))
        middle = F.percentile_approx(F.when(inside, F.col("v")), F.array(*[F.lit(x / 40) for x in range(41)]), F.lit(ACCURACY))
        counts = {(r["g"], r["i"]): r for r in near.groupBy("g", "i").agg(F.count_if(F.col("v") < F.col("lo")).alias("below"), F.count_if(inside).alias("inside"), middle.alias("m")).collect()}
        ready, again = [], []
        for j in jobs:
            c = counts[j["g"], j["i"]]
            j["below"] = c["below"]
            if c["below"] > j["low"] or c["below"] + c["inside"] <= j["high"]:  # the sketch missed: the whole group
                again.append({**j, "lo": -math.inf, "hi": math.inf})
            elif c["inside"] > FETCH_LIMIT / len(jobs) and j["lo"] < j["hi"] and c["m"][0] < c["m"][-1]:
                share = lambda k: (k - c["below"]) / c["inside"] * 40  # noqa: B023, E731
                lo, hi = c["m"][max(0, math.floor(share(j["low"])) - 1)], c["m"][min(40, math.ceil(share(j["high"])) + 1)]
                (ready if (lo, hi) == (j["lo"], j["hi"]) else again).append({**j, "lo": lo, "hi": hi})
            else:
                ready.append(j)
        if ready:
            wanted = spark.createDataFrame([(j["g"], j["i"]) for j in ready], "g int, i int")
            kept = near.where(inside).join(F.broadcast(wanted), ["g", "i"]).groupBy("g", "i", "v").agg(F.count(F.lit(1)).alias("n")).collect()
            values: dict[tuple[int, int], list[tuple[float, int]]] = {}
            for r in kept:
                values.setdefault((r["g"], r["i"]), []).append((r["v"], r["n"]))
            for j in ready:
                ordered, at, picked = sorted(values[j["g"], j["i"]]), j["below"], {}
                for x, n in ordered:
                    for rank in (j["low"], j["high"]):
                        if at <= rank < at + n:
                            picked[rank] = x
                    at += n
                share = probs[j["i"]] * (first[j["g"]]["n"] - 1) - j["low"]
                found[j["g"], j["i"]] = picked[j["low"]] + share * (picked[j["high"]] - picked[j["low"]])
        jobs = again
    schema = StructType([*[StructField(k, rows.schema[n].dataType) for k, n in zip(keys, names)], StructField(out, ArrayType(DoubleType()))])
    return spark.createDataFrame([(*[r[k] for k in names], [found.get((g, i)) for i in range(len(probs))]) for g, r in enumerate(first)], schema)
