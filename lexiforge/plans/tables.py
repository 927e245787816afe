"""Access to the tables of a data folder, and SQL fragments that several counterparts share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_hash(seed, *keys: str) -> str:
    return f"md5(concat_ws('|', '{seed}', {', '.join(keys)}))"


def sql_index(n, seed, *keys: str) -> str:
    return f"(('0x' || substr({sql_hash(seed, *keys)}, 1, 8))::BIGINT % {n})"


SQL_SQUASH = "trim(regexp_replace({0}, '[\\s\\p{{Z}}]+', ' ', 'g'), ' ')"
SQL_STRIP = "regexp_replace({0}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"


def squash(x: str) -> str:
    return SQL_SQUASH.format(x)


def strip(x: str) -> str:
    return SQL_STRIP.format(x)
