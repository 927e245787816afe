"""Vectors and weight merging in long form: (key, idx, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from . import merging


def long_form(rows: DataFrame, keys: list[str], vector: str) -> DataFrame:
    return rows.select(*keys, F.posexplode(vector).alias("idx", "value")).withColumn("value", F.col("value").cast("double"))


def mean_vectors(rows: DataFrame, group: str, vector: str) -> DataFrame:
    """Component-wise means in long form."""
    return long_form(rows, [group], vector).groupBy(group, "idx").agg(F.avg("value").alias("value"))


def weighted_vectors(links: DataFrame, key: str, other: str, weight: str, rows: DataFrame, row_key: str, vector: str) -> DataFrame:
    """New rows as weighted means of the rows that they are linked to; links to nothing do not count."""
    found = links.join(rows.select(F.col(row_key).alias(other), vector), other)
    wide = found.select(key, weight, F.posexplode(vector).alias("idx", "x"))
    return wide.groupBy(key, "idx").agg((F.sum(F.col(weight) * F.col("x")) / F.sum(weight)).alias("value"))


def vector_stats(rows: DataFrame, group: str, vector: str, dead: float = 1e-8) -> DataFrame:
    """Mean and largest magnitude, share of non-zeros, and vectors that are nowhere above ``dead``."""
    magnitudes = F.transform(vector, lambda x: F.abs(x.cast("double")))
    slim = rows.select(
        group, F.size(vector).alias("_n"), F.aggregate(magnitudes, F.lit(0.0), lambda a, x: a + x).alias("_sum"), F.array_max(magnitudes).alias("_max"),
        F.size(F.filter(magnitudes, lambda x: x > 0)).alias("_nonzero"),
    )
    return slim.groupBy(group).agg(
        (F.sum("_sum") / F.sum("_n")).alias("mean_abs"), F.max("_max").alias("max_abs"), (100.0 * F.sum("_nonzero") / F.sum("_n")).alias("nonzero_percent"), F.count_if(F.col("_max") < dead).alias("dead")
    )


def ties_merge(parts: DataFrame, key: str, model: str, weights: dict[str, float], density: float, scale: float = 1.0) -> DataFrame:
    """``merging.ties_merge`` with a weight for each model by name (0 for others) and one density."""
    weight = F.lit(0.0)
    for name, w in weights.items():
        weight = F.when(F.col(model) == name, w).otherwise(weight)
    return merging.ties_merge(parts, key, model, weight, F.lit(density), scale)


def drift_tied(pairs: DataFrame, a: str, b: str, most: float = 0.1) -> DataFrame:
    """Adds drift (1 - cosine); vectors that drifted further than ``most`` are both replaced by their mean."""
    drift = 1 - X.cosine(a, b)
    mean = F.zip_with(a, b, lambda x, y: (x.cast("double") + y.cast("double")) / 2)
    out = pairs.withColumn("drift", drift)
    far = F.col("drift") > most
    return out.withColumn("tied", F.when(far, mean).otherwise(F.transform(a, lambda x: x.cast("double")))).withColumn("averaged", far)


def aligned_weights(rows: DataFrame, scores: str, epsilon: float = 0.01) -> DataFrame:
    """Scores become shares, smoothed and rounded to 3 digits, where there are exactly two; others stay."""
    total = F.aggregate(scores, F.lit(0.0), lambda acc, x: acc + x + epsilon)
    return rows.withColumn("weights", F.when(F.size(scores) == 2, F.transform(scores, lambda x: F.round((x + epsilon) / total, 3))).otherwise(F.col(scores)))


def init_report(links: DataFrame, token: str, other: str, known: DataFrame, known_key: str) -> DataFrame:
    """One row: tokens, from_cognates (with a known linked vector), random_init (without), rate in percent, and the
    tokens of several links as multi."""
    found = links.join(known.select(F.col(known_key).alias(other), F.lit(1).alias("_known")), other, "left")
    each = found.groupBy(token).agg(F.count("_known").alias("hits"), F.count("*").alias("linked"))
    return each.agg(
        F.count("*").alias("tokens"), F.count_if(F.col("hits") > 0).alias("from_cognates"), F.count_if(F.col("hits") == 0).alias("random_init"),
        F.round(100.0 * F.count_if(F.col("hits") > 0) / F.greatest(F.count("*"), F.lit(1)), 6).alias("rate"), F.count_if(F.col("linked") > 1).alias("multi"),
    )


def failed_tokens(links: DataFrame, token: str, other: str, known: DataFrame, known_key: str) -> DataFrame:
    """Tokens none of whose links leads to a known vector."""
    good = links.join(known.select(F.col(known_key).alias(other)), other, "left_semi").select(token)
    return links.select(token).distinct().join(good, token, "left_anti")
