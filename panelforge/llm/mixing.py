"""Sources mixed to target shares by systematic sampling, with capped repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from panelforge.session import cut_lineage

#: Sources of a mix are a declared list of at most this many.
SOURCE_LIMIT = 10_000
#: Documents that one stretch of the sampling order holds, on average.
STRETCH = 1_000_000


def mix_copies(docs: DataFrame, key: str, source: str, size: str, targets: DataFrame, total: float | None = None, seed: int = 11) -> DataFrame:
    """How often each document is used so that every source contributes its target share of the total size.

    ``targets``: source, target_share, max_repeats. ``total``: size of the mix; by default the largest at which every source that has any size
    can reach its share within its repeats. Every document of a source has the same expected copies, total * share / size of the
    source, at most ``max_repeats``. Within a source, documents are laid out by size (in pieces by size class and hash); the expected copies
    are summed along that order, one random offset is added, and a document is used once for each integer that its stretch crosses. So
    copies differ from the expectation by less than one, neighbours in size stand in for each other, and the size used of a source differs from its
    share by little more than its largest document.

    The prefix sums are two-level: positions inside a stretch (a piece of one source of bounded size) and counts of whole stretches, so
    a source with a third of all rows is never in one task.

    Result: key, source, size, copies (long), every row once. Cases: a document without size (null or 0), of a null source or of one without
    target is used 0 times; sources without any size are left out and the others' shares scaled up; keys may repeat: each row counts
    by itself (rows equal in key and size are tied in the order and get the lot's copies in any order); an empty table gives no rows.
    """
    spark = docs.sparkSession
    wanted = [r.asDict() for r in targets.where("source IS NOT NULL AND target_share > 0").groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("cap")).limit(SOURCE_LIMIT + 1).collect()]
    if len(wanted) > SOURCE_LIMIT:
        raise ValueError("too many sources")
    rows = cut_lineage(docs.select(F.col(key).alias("k"), F.col(source).alias("src"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("size")))
    sums = rows.join(F.broadcast(spark.createDataFrame([(w["source"],) for w in wanted], "src string")), "src", "left_semi").groupBy("src").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n")).collect()  # at most SOURCE_LIMIT rows
    sizes = {r["src"]: (r["s"], r["n"]) for r in sums}
    live = [w for w in wanted if sizes.get(w["source"], (0, 0))[0] > 0 and (w["cap"] or 0) > 0]
    whole = sum(w["share"] for w in live) or 1.0
    reach = min((w["cap"] * sizes[w["source"]][0] * whole / w["share"] for w in live), default=0.0)
    volume = reach if total is None else total
    plan = [(w["source"], min(float(w["cap"]), volume * w["share"] / whole / sizes[w["source"]][0]), max(1, -(-sizes[w["source"]][1] // STRETCH))) for w in live]
    rates = spark.createDataFrame(plan, "src string, rate double, stretches int")
    h = F.xxhash64(F.lit(seed), F.col("k"))
    placed = rows.join(F.broadcast(rates), "src", "left")
    used = placed.where((F.col("size") > 0) & F.col("rate").isNotNull()).withColumn("cls", F.floor(4 * F.log2("size")).cast("int")).withColumn("h", h)
    used = used.withColumn("stretch", F.pmod(F.shiftright("h", 20), F.col("stretches")).cast("int"))
    counts = used.groupBy("src", "cls", "stretch").agg(F.count(F.lit(1)).alias("n"))  # sources * size classes * stretches
    ahead = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("src").orderBy("cls", "stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    own = Window.partitionBy("src", "cls", "stretch").orderBy("size", "h", "k")
    ranked = used.withColumn("r", F.row_number().over(own)).join(ahead, ["src", "cls", "stretch"])  # both sides lie by stretch already
    offset = (F.pmod(F.xxhash64(F.lit(seed), F.col("src")), F.lit(1_000_003)) + 0.5) / 1_000_003
    end = F.col("before") + F.col("r")
    copies = F.floor(end * F.col("rate") + offset) - F.floor((end - 1) * F.col("rate") + offset)
    idle = placed.where((F.col("size") <= 0) | F.col("rate").isNull())
    out = ranked.select("k", "src", "size", copies.cast("long").alias("copies")).unionByName(idle.select("k", "src", "size", F.lit(0).cast("long").alias("copies")))
    return out.select(F.col("k").alias(key), F.col("src").alias(source), F.col("size").alias(size), "copies")


def mix_shares(copies: DataFrame, targets: DataFrame, source: str = "source", size: str = "n_tokens") -> DataFrame:
    """Target share, actual share, size used and greatest repeat of each source with a target."""
    got = copies.groupBy(F.col(source).alias("__s")).agg(F.sum(F.col(size) * F.col("copies")).alias("used"), F.sum(size).alias("available"), F.max("copies").alias("most_copies"))
    both = targets.join(got, F.col("source") == F.col("__s"), "left").withColumn("used", F.coalesce("used", F.lit(0)))
    out = both.withColumn("all_used", F.sum("used").over(Window.partitionBy()))  # one row a source
    return out.select("source", "target_share", "max_repeats", F.coalesce("available", F.lit(0)).alias("available"), "used", F.coalesce("most_copies", F.lit(0)).alias("most_copies"), F.round(F.try_divide("used", "all_used"), 6).alias("actual_share"))
