"""All named queries of the library outside the training-data subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import corpus, evaluation, mixing, subwords, vectors

MODULES = (corpus, mixing, evaluation, subwords, vectors)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.flagship(spark, sf_dir)


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
