"""Queries p3, p8, p9 and p10 over the project's tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelforge.llm.language import document_languages, fit_model, identify
from panelforge.llm.mixing import mix_copies, mix_shares
from panelforge.llm.prefix_bpe import TOKENIZER_DIR, encode_corpus
from panelforge.llm.survivors import survivors

#: Declared order of trust in a link type; None is a missing one.
LINK_TRUST: tuple[str | None, ...] = ("P", "C", "J", "N", None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _survivors(spark: SparkSession, sf_dir: str, judged: tuple[str, ...] = (), multi: str | None = None) -> DataFrame:
    ccm = table(spark, sf_dir, "ccm_merged")
    month = F.date_format("MthCalDt", "yyyy-MM")
    return survivors(ccm, (F.col("PERMNO"), month), "gvkey", "datadate", "MthCalDt", "ULINKPRIM", LINK_TRUST, "loaded_at", multi=multi, judged=judged)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _survivors(spark, sf_dir)
    return s.select(F.col("g1").alias("permno"), F.col("g2").alias("mth"), F.coalesce("gvkey", F.lit(0)).alias("gvkey"), F.coalesce(F.date_format("datadate", "yyyy-MM-dd"), F.lit("")).alias("datadate"))


P3_FOUND = """
WITH r AS (SELECT PERMNO permno, strftime(MthCalDt, '%Y-%m') mth, gvkey, datadate, MthCalDt, loaded_at,
  CASE ULINKPRIM WHEN 'P' THEN 0 WHEN 'C' THEN 1 WHEN 'J' THEN 2 WHEN 'N' THEN 3 ELSE CASE WHEN ULINKPRIM IS NULL THEN 4 ELSE 5 END END k FROM ccm_merged WHERE PERMNO IS NOT NULL AND MthCalDt IS NOT NULL),
g AS (SELECT permno, mth FROM r GROUP BY 1, 2 HAVING count(*) >= 2),
b AS (SELECT permno, mth, gvkey, row_number() OVER (PARTITION BY permno, mth ORDER BY k, loaded_at DESC NULLS LAST, gvkey DESC) n FROM r WHERE gvkey IS NOT NULL),
d AS (SELECT permno, mth, gvkey, max(datadate) FILTER (WHERE datadate <= MthCalDt) e FROM r GROUP BY 1, 2, 3)
SELECT g.permno, g.mth, coalesce(b.gvkey, 0) gvkey, coalesce(strftime(d.e, '%Y-%m-%d'), '') datadate
FROM g LEFT JOIN b ON b.permno = g.permno AND b.mth = g.mth AND b.n = 1 LEFT JOIN d ON d.permno = g.permno AND d.mth = g.mth AND d.gvkey = b.gvkey
"""


def p3_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surviving records with confidence, further fields and every ticker judged true."""
    s = _survivors(spark, sf_dir, ("MthRet", "MthCap", "at", "ceq"), "Ticker")
    return s.withColumnsRenamed({"g1": "permno", "g2": "mth"}).withColumn("key_p", F.round("key_p", 6)).withColumn("Ticker_values", F.array_join("Ticker_values", ","))


def p8_ids(spark: SparkSession, sf_dir: str, folder: str = TOKENIZER_DIR) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"), "doc_id", "text", "byte_bpe_50k", folder)


def _sized(spark: SparkSession, sf_dir: str, folder: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents")
    both = docs.select(F.struct("doc_id", "source").alias("k"), "text")
    sized = encode_corpus(both, "k", "text", "byte_bpe_50k", folder, counts_only=True).select("k.doc_id", "k.source", "n_tokens")
    return sized, table(spark, sf_dir, "mix_targets")


def p9_copies(spark: SparkSession, sf_dir: str, folder: str = TOKENIZER_DIR) -> DataFrame:
    """How often each document is used in the mix."""
    sized, targets = _sized(spark, sf_dir, folder)
    return mix_copies(sized, "doc_id", "source", "n_tokens", targets).select("doc_id", "source", "n_tokens", "copies")


def p9_shares(spark: SparkSession, sf_dir: str, folder: str = TOKENIZER_DIR) -> DataFrame:
    """Target and actual share of each source."""
    sized, targets = _sized(spark, sf_dir, folder)
    return mix_shares(mix_copies(sized, "doc_id", "source", "n_tokens", targets), targets)


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_model(table(spark, sf_dir, "lang_samples"), table(spark, sf_dir, "lang_codes"), docs)
    return identify(docs, model, "doc_id", "text", "lang", "path", "repo", "source")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    langs = document_languages(_segments(spark, sf_dir), "doc_id")
    right = F.coalesce(F.col("declared") == F.col("lang"), F.lit(False))
    return langs.where((F.col("n_langs") > 1) | ~right).select("doc_id", "lang")


def p10_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every segment of every document with its language and confidence."""
    return _segments(spark, sf_dir).withColumn("confidence", F.round("confidence", 6))


def queries() -> dict:
    return {
        "p3_found": p3_found,
        "p3_survivors": p3_survivors,
        "p8_ids": p8_ids,
        "p9_copies": p9_copies,
        "p9_shares": p9_shares,
        "p10_found": p10_found,
        "p10_segments": p10_segments,
    }


def oracle_sql() -> dict[str, str]:
    return {"p3_found": P3_FOUND}
