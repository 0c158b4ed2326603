"""Readers of raw files: all-string scans with null tokens, embedded blocks, several series, aliases of headers, typed casts."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelforge.functions.scalar import null_tokens, parse_day

NULL_TOKENS = ("", "NA", "NaN")
#: How the factor library writes a missing figure.
FACTOR_MISSING = ("-99.99", "-999")


@dataclass(frozen=True)
class RawFiles:
    """Names of raw inputs and where they lie; a missing one raises FileNotFoundError."""

    root: str
    names: dict[str, str] = field(default_factory=dict)

    def path(self, spark: SparkSession, key: str) -> str:
        if key not in self.names:
            raise FileNotFoundError(f"no raw file is known as {key}")
        full = f"{self.root.rstrip('/')}/{self.names[key]}"
        jpath = spark._jvm.org.apache.hadoop.fs.Path(full)
        if not jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
            raise FileNotFoundError(full)
        return full


def read_strings(spark: SparkSession, path: str, tokens: Iterable[str] = NULL_TOKENS) -> DataFrame:
    """A headed CSV with every column as text; null tokens become null. Nothing is inferred, so there is one pass over the file."""
    raw = spark.read.option("header", True).option("inferSchema", False).option("mode", "PERMISSIVE").csv(path)
    return raw.select(*[null_tokens(F.col(f"`{c}`"), tuple(tokens)).alias(c) for c in raw.columns])


def read_inferred(spark: SparkSession, path: str) -> DataFrame:
    """A small headed CSV with inferred types."""
    return spark.read.option("header", True).option("inferSchema", True).option("nullValue", "NA").csv(path)


@dataclass(frozen=True)
class Types:
    """Which columns are dates, integers, long integers or text; ``other`` is the type of all the rest."""

    dates: frozenset[str] = frozenset()
    ints: frozenset[str] = frozenset()
    longs: frozenset[str] = frozenset()
    texts: frozenset[str] = frozenset()
    other: str = "float"

    def cast(self, name: str) -> Column:
        c = F.col(f"`{name}`")
        if name in self.dates:
            out = parse_day(c.cast("string"))
        elif name in self.ints:
            out = c.try_cast("int")
        elif name in self.longs:
            out = c.try_cast("long")
        elif name in self.texts:
            out = c.cast("string")
        else:
            out = c.try_cast(self.other)
        return out.alias(name)


#: The merged monthly file: what is not named here is a figure.
CCM_TYPES = Types(
    dates=frozenset({"MthCalDt", "datadate", "fdate"}), ints=frozenset({"PERMNO", "gvkey"}), longs=frozenset({"MthVol", "ShrOut"}), texts=frozenset({"Ticker", "ULINKPRIM"})
)
#: The daily file: what is not named here stays text.
DAILY_TYPES = Types(dates=frozenset({"date"}), ints=frozenset({"PERMNO"}), longs=frozenset({"VOL"}), texts=frozenset({"src"}), other="string")


def typed(df: DataFrame, types: Types) -> DataFrame:
    """All columns cast by name in one projection; a value that doesn't fit becomes null."""
    return df.select(*[types.cast(c) for c in df.columns])


#: Lines that a file with an embedded block may have: a century of days ten times over.
BLOCK_LINES = 500_000
_DATE_TOKEN = r"^\s*\d{6,8}\s*$"


def read_embedded_block(spark: SparkSession, path: str, missing: Iterable[str] = FACTOR_MISSING, date: str = "date") -> DataFrame:
    """The first block of lines whose first field is a date of 6 to 8 digits, with the line before it as header; an empty first name is the date.

    Such files are published tables of a few thousand lines, so one reader task finds the block; more than BLOCK_LINES are refused. Values equal to
    a missing code are null.
    """
    lines = [r[0] for r in spark.read.text(path, wholetext=False).coalesce(1).limit(BLOCK_LINES + 1).collect()]
    if len(lines) > BLOCK_LINES:
        raise ValueError(f"{path} has more than {BLOCK_LINES} lines")
    is_row = [bool(x.strip()) and re.match(_DATE_TOKEN, x.strip().split(",")[0]) is not None for x in lines]
    if True not in is_row:
        raise ValueError(f"{path} has no block of dated lines")
    start = is_row.index(True)
    stop = next((i for i in range(start, len(lines)) if not is_row[i]), len(lines))
    names = [x.strip() for x in lines[start - 1].split(",")] if start else []
    names = [date if i == 0 and not x else x for i, x in enumerate(names)]
    codes = {float(m) for m in missing}
    rows = []
    for line in lines[start:stop]:
        parts = [x.strip() for x in line.split(",")]
        values = []
        for x in parts[1 : len(names)]:
            try:
                v = float(x)
            except ValueError:
                v = None
            values.append(None if v is None or v in codes else v)
        rows.append((parts[0], *values, *[None] * (len(names) - 1 - len(values))))
    schema = ", ".join([f"`{names[0]}` string", *[f"`{c}` double" for c in names[1:]]])
    return spark.createDataFrame(rows, schema).withColumn(names[0], F.to_date(F.col(f"`{names[0]}`"), "yyyyMMdd"))


def first_alias(columns: Iterable[str], names: Iterable[str]) -> str | None:
    """The column that goes by one of the names, in any case; the first name that fits wins."""
    lower = {c.lower(): c for c in columns}
    return next((lower[n] for n in names if n in lower), None)


def read_series(spark: SparkSession, paths: dict[str, str], date_names: tuple[str, ...] = ("date", "observation_date")) -> DataFrame:
    """One file a series, outer-joined on the date; figures that don't parse become null."""
    out = None
    for name, path in paths.items():
        raw = read_strings(spark, path, (*NULL_TOKENS, "."))
        d = first_alias(raw.columns, date_names)
        if d is None:
            raise ValueError(f"{path} has no date column")
        value = next(c for c in raw.columns if c != d)
        s = raw.select(parse_day(F.col(f"`{d}`")).alias("date"), F.col(f"`{value}`").try_cast("double").alias(name)).where("date IS NOT NULL")
        out = s if out is None else out.join(s, "date", "full_outer")
    return out


def profile_folder(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Rows, columns and schema of several parquet tables."""
    rows = []
    for name, path in sorted(paths.items()):
        t = spark.read.parquet(path)
        rows.append((name, t.count(), len(t.columns), t.schema.simpleString()))
    return spark.createDataFrame(rows, "tbl string, n long, n_columns int, layout string")
