"""Deduplication with a defined survivor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X


def text_key(c) -> Column:
    """White space collapsed, lower case."""
    return F.lower(X.squash(c))


def digest(keys: list) -> Column:
    """256 bits that tell apart rows whose keys differ; nulls are keys too."""
    values = [X.col(k).cast("string") for k in keys]
    parts = [F.when(v.isNull(), "n").otherwise(F.concat(F.length(v).cast("string"), F.lit(":"), v)) for v in values]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def first_wins(rows: DataFrame, keys: list, order: list) -> DataFrame:
    """Of rows with equal keys, the first in the order; order must be unique within a key.

    Rows are brought together by a 256-bit digest of their keys. Each task keeps its first row of a key before
    the shuffle, so a key that very many rows share is no burden.
    """
    place = F.row_number().over(Window.partitionBy(digest(keys)).orderBy(*order))
    return rows.withColumn("_place", place).filter("_place = 1").drop("_place")


def capped_chain(sources: list[tuple[DataFrame, int | None]], key: str, order: str) -> DataFrame:
    """Sources in turn: rows new to all before, first of each key, at most the cap of each source.

    Rows beyond a cap never count as seen, so the sources are chained rather than ranked at once.
    """
    kept = None
    for rows, cap in sources:
        if kept is not None:
            rows = rows.join(kept.select(key), key, "left_anti")
        rows = first_wins(rows, [key], [order])
        if cap is not None:
            rows = rows.orderBy(order).limit(cap)
        kept = rows if kept is None else kept.unionByName(rows, allowMissingColumns=True)
    return kept


def priority_pick(rows: DataFrame, key, priority, order) -> DataFrame:
    """Of each key the row of highest priority; the first of equals."""
    return first_wins(rows, [key], [F.desc(priority) if isinstance(priority, str) else priority.desc(), order])


def upsert(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """All keys; where both have one, the new value."""
    joined = old.select(key, F.col(value).alias("_old")).join(new.select(key, F.col(value).alias("_new"), F.lit(True).alias("_is_new")), key, "full_outer")
    return joined.select(key, F.when(F.col("_is_new"), F.col("_new")).otherwise(F.col("_old")).alias(value))
