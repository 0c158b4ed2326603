"""Sinks: parquet with a staging folder, nested parquet for parameters, JSON, CSV and LaTeX tables, logged statistics."""

from __future__ import annotations

import json
import logging
from dataclasses import asdict, is_dataclass

from pyspark.sql import Column, DataFrame, SparkSession

log = logging.getLogger("panelforge")


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Written beside the target and moved into its place when complete, so a reader never sees half a table.

    An old table is moved aside first and comes back if the new one can't take its place; what lies beside the target is removed in any case.
    """
    path = path.rstrip("/")
    staging, aside = path + ".tmp", path + ".old"
    target, fs = _fs(df.sparkSession, path)
    source, old = (_fs(df.sparkSession, x)[0] for x in (staging, aside))
    w = df.write.mode("overwrite").option("compression", "snappy")
    try:
        (w.partitionBy(*partition_by) if partition_by else w).parquet(staging)
        fs.delete(old, True)
        if fs.exists(target) and not fs.rename(target, old):
            raise OSError(f"{path} could not be moved aside")
        if not fs.rename(source, target):
            fs.rename(old, target)
            raise OSError(f"{staging} could not be moved to {path}")
        fs.delete(old, True)
    finally:
        fs.delete(source, True)


def write_json(spark: SparkSession, value: object, path: str) -> None:
    """A small configuration object as JSON."""
    text = json.dumps(asdict(value) if is_dataclass(value) else value, indent=2, sort_keys=True, default=str)
    p, fs = _fs(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def write_csv(df: DataFrame, path: str) -> None:
    """A result table of a few rows as one headed CSV file."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


_TEX = {"&": r"\&", "%": r"\%", "_": r"\_", "#": r"\#", "$": r"\$"}


def latex_table(df: DataFrame, limit: int = 1_000) -> str:
    """A result table as a LaTeX tabular: four decimals for floats; refused above ``limit`` rows."""
    rows = df.take(limit + 1)
    if len(rows) > limit:
        raise ValueError("too many rows for a printed table")

    def cell(v: object) -> str:
        text = "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
        return "".join(_TEX.get(c, c) for c in text)

    lines = [r"\begin{tabular}{" + "l" * len(df.columns) + "}", r"\hline", " & ".join(cell(c) for c in df.columns) + r" \\", r"\hline"]
    lines += [" & ".join(cell(v) for v in r) + r" \\" for r in rows]
    return "\n".join([*lines, r"\hline", r"\end{tabular}", ""])


def logged(df: DataFrame, name: str, *stats: Column) -> dict:
    """One pass of aggregates over a table, logged and returned."""
    row = df.agg(*stats).first().asDict()
    log.info("%s: %s", name, row)
    return row
