"""All queries of the core and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelforge.plans import evaluation, gates, library, modeling, prepare, relational


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.char_panel_ranked(spark, sf_dir)


def queries() -> dict:
    return {**relational.queries(), **evaluation.queries(), **modeling.queries(), **library.queries(), **gates.queries(), **prepare.queries()}


def oracle_sql() -> dict[str, str]:
    return {**relational.oracle_sql(), **evaluation.oracle_sql(), **modeling.oracle_sql(), **library.oracle_sql(), **prepare.oracle_sql()}
