"""Counts and reports over corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X


def histogram(rows: DataFrame, group: str) -> DataFrame:
    counts = rows.groupBy(group).agg(F.count("*").alias("n"))
    total = rows.agg(F.greatest(F.count("*"), F.lit(1)).alias("_total"))
    return counts.crossJoin(F.broadcast(total)).select(group, "n", F.round(100.0 * F.col("n") / F.col("_total"), 6).alias("percent"))


def split_counts(rows: DataFrame, group: str, splits: tuple[str, ...] = ("train", "dev", "test")) -> DataFrame:
    """Rows of each split by group, and in total."""
    counted = rows.rollup(group).agg(*(F.count_if(F.col("split") == s).alias(s) for s in splits))
    return counted.withColumn(group, F.coalesce(group, F.lit("total")))


def kept_rollup(rows: DataFrame, group: str, keep: Column) -> DataFrame:
    counted = rows.rollup(group).agg(F.count("*").alias("input"), F.count_if(keep).alias("kept"), F.count_if(~keep).alias("dropped"))
    return counted.withColumn(group, F.coalesce(group, F.lit("total")))


def quality_report(rows: DataFrame, group: str, text_col: str, bad: str) -> DataFrame:
    """What became of the rows of each group; each counts once, under the first check that it fails.

    Repeats are told by a 256-bit digest, counted before and after the shuffle: texts do not travel, and a text
    that very many rows share is one count.
    """
    text = F.col(text_col)
    empty = text.isNull() | (F.trim(text) == "")
    filtered = F.coalesce(F.contains(text, F.lit(bad)), F.lit(False))
    slim = rows.select(group, F.when(empty, "empty").when(filtered, "filtered").alias("early"), F.sha2(text, 256).alias("key"))
    counted = slim.groupBy(group, "early", "key").agg(F.count("*").alias("n"))
    early, n = F.col("early"), F.col("n")
    counts = {"skipped_empty": F.when(early == "empty", n), "filtered": F.when(early == "filtered", n), "duplicates": F.when(early.isNull(), n - 1), "kept": F.when(early.isNull(), 1)}
    return counted.groupBy(group).agg(F.sum("n").alias("loaded"), *(F.coalesce(F.sum(c), F.lit(0)).alias(name) for name, c in counts.items()))


def word_frequency(rows: DataFrame, text_col: str, order: str, pattern: str) -> DataFrame:
    """Words with their count and the first row that has them. Counts are summed before the shuffle."""
    found = rows.select(order, F.explode(F.regexp_extract_all(F.lower(text_col), F.lit(pattern), F.lit(0))).alias("word"))
    return found.groupBy("word").agg(F.count("*").alias("n"), F.min(order).alias("first_doc"))


def corpus_totals(rows: DataFrame, group: str, text_col: str, separator: int) -> DataFrame:
    """Characters and bytes of the texts joined by a separator of that length, and words."""
    between = separator * (F.count("*") - 1)
    return rows.groupBy(group).agg(
        (F.sum(F.length(text_col)) + between).alias("chars"),
        (F.sum(F.octet_length(text_col)) + between).alias("bytes"),
        F.sum(X.word_count(text_col).cast("long")).alias("words"),
    )


def capped_report(rows: DataFrame, group: str, checks: dict[str, Column], key: list, order: str, cap: int | None, created: Column | None = None) -> DataFrame:
    """(group, loaded, one count for each check, duplicates_removed, kept, codeswitched_created): what became of the rows
    of a group, read in order up to the row that fills its cap.

    A row counts once, under the first check that holds for it; one that passes all is a duplicate if the group has kept
    its key already. ``created`` marks rows that were made, counted among those kept. Keys travel as digests; of each
    key a task sends its first row only, and of each group no more than the cap is ranked.
    """
    from .dedup import digest

    status = F.lit(None).cast("string")
    for name, holds in reversed(checks.items()):
        status = F.when(F.coalesce(holds, F.lit(False)), name).otherwise(status)
    made = F.coalesce(created, F.lit(False)) if created is not None else F.lit(False)
    slim = rows.select(group, F.col(order).alias("_order"), status.alias("_status"), digest(key).alias("_key"), made.alias("_made"))
    first = slim.filter("_status IS NULL").groupBy(group, "_key").agg(F.min_by("_made", "_order").alias("_made"), F.min("_order").alias("_order"))
    place = F.row_number().over(Window.partitionBy(group).orderBy("_order"))
    kept = first.withColumn("_place", place).filter(F.col("_place") <= cap) if cap is not None else first
    kept = kept.groupBy(group).agg(F.count("*").alias("kept"), F.max("_order").alias("_last"), F.count_if("_made").alias("codeswitched_created"))
    # a group that never fills its cap is read to its end
    full = F.col("kept") >= cap if cap is not None else F.lit(False)
    read = slim.join(F.broadcast(kept), group, "left").filter(~F.coalesce(full, F.lit(False)) | (F.col("_order") <= F.col("_last")))
    passed = F.count_if(F.col("_status").isNull())
    keeps = F.coalesce(F.max("kept"), F.lit(0))
    return read.groupBy(group).agg(
        F.count("*").alias("loaded"), *(F.count_if(F.col("_status") == name).alias(name) for name in checks),
        (passed - keeps).alias("duplicates_removed"), keeps.alias("kept"), F.coalesce(F.max("codeswitched_created"), F.lit(0)).alias("codeswitched_created"),
    )
