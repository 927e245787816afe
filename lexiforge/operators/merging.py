"""Merging of models' weights in long form (key, idx, model, value): exact selection without sorting, then one aggregation.

The k largest magnitudes of a tensor are found by radix passes: each counts the values of a range in cells, takes the
cell that holds the k-th one as the next range, and ends when a range is one value. Only counts are shuffled, however
large a tensor is; among equals at the end, the smallest indices are found in the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cells of a range.
CELLS = 4096
#: Tensors' keys that are never trimmed, unless they are factors of low rank.
FULL = r"embed_tokens|lm_head"
FACTORS = r"lora_[AB]"


def _exponent(x: Column) -> Column:
    """A number that rises with x, finer than its power of two: the first range has values of any size."""
    size = F.abs(x)
    code = F.when(size > 0, F.log2(size) + 1100.0).otherwise(0.0)
    return F.when(x < 0, -code).otherwise(code)


def kth_smallest(rows: DataFrame, group: list[str], value: Column, k: DataFrame) -> DataFrame:
    """(group, value, below, equal): of each group its k-th smallest value, how many are smaller, and how many are
    equal. k: rows (group, k), from 1 to the size of the group.

    The driver holds one row for each group (a tensor of a model), as a header of a weights file does. rows are read
    once for each pass: one over all magnitudes, then one for every 12 bits in which values of like size differ.
    """
    spark = rows.sparkSession
    slim = rows.select(*group, value.cast("double").alias("_x"))
    state = [(*(r[c] for c in group), r["k"], 0, None, None) for r in k.collect()]
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in group)
    schema = f"{kinds}, _k long, _below long, _low double, _high double"
    done: list[tuple] = []
    first = True
    while state:
        ranges = spark.createDataFrame(state, schema)
        x = F.col("_x")
        inside = slim.join(F.broadcast(ranges) if len(state) <= 10_000 else ranges, group)
        if first:
            # 2200 powers of two on either side of zero
            cell = F.floor((_exponent(x) + 2200.0) * (CELLS * 4 / 4400.0))
        else:
            inside = inside.filter((x >= F.col("_low")) & (x <= F.col("_high")))
            # half the width cannot overflow
            width = F.col("_high") / 2 - F.col("_low") / 2
            cell = F.least(F.floor((x / 2 - F.col("_low") / 2) / width * CELLS), F.lit(CELLS - 1))
        counts = inside.groupBy(*group, "_k", "_below", cell.alias("_cell")).agg(F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_low"), F.max("_x").alias("_high"))
        before = F.sum("_n").over(Window.partitionBy(*group).orderBy("_cell")) - F.col("_n")
        found = counts.withColumn("_before", before).filter((F.col("_before") < F.col("_k")) & (F.col("_before") + F.col("_n") >= F.col("_k")))
        state = []
        for r in found.collect():
            at = tuple(r[c] for c in group)
            if r["_low"] == r["_high"]:
                done.append((*at, r["_low"], r["_below"] + r["_before"], r["_n"]))
            else:
                state.append((*at, r["_k"] - r["_before"], r["_below"] + r["_before"], r["_low"], r["_high"]))
        first = False
    return spark.createDataFrame(done, f"{kinds}, value double, below long, equal long")


def marked(parts: DataFrame, key: str, model: str, density: Column) -> DataFrame:
    """Adds stays: of each key and model, whether a value is one of the floor(density * n) largest magnitudes, at least
    one, the smaller idx of equals. density: an expression on key and model."""
    group = [key, model]
    sizes = parts.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    # tensors that keep everything need no selection
    cut = sizes.select(*group, "n", F.greatest(F.floor(F.col("n") * density), F.lit(1)).alias("k")).filter("k < n")
    size = -F.abs(F.col("value"))
    found = kth_smallest(parts, group, size, cut.select(*group, "k")).join(cut.select(*group, "k"), group)
    rest = F.col("k") - F.col("below")
    limits = found.select(*group, F.col("value").alias("_limit"), rest.alias("_rest"), (F.col("equal") > rest).alias("_tied"))
    held = parts.join(limits, group, "left")
    # of equals at the limit, those with the smallest indices
    ties = held.filter(F.col("_tied") & (size == F.col("_limit")))
    last = kth_smallest(ties, group, F.col("idx"), limits.filter("_tied").select(*group, F.col("_rest").alias("k")))
    held = held.join(last.select(*group, F.col("value").cast("long").alias("_last")), group, "left")
    equal = (size == F.col("_limit")) & (F.col("_last").isNull() | (F.col("idx") <= F.col("_last")))
    return held.withColumn("stays", F.col("_limit").isNull() | (size < F.col("_limit")) | equal).select(*parts.columns, "stays")


def density_of(key: str, density: float) -> Column:
    """``density``, but 1 for whole embedding and output tensors, whose rows are words."""
    return F.when(F.col(key).rlike(FULL) & ~F.col(key).rlike(FACTORS), 1.0).otherwise(density)


def ties_merge(parts: DataFrame, key: str, model: str, weight: Column, density: Column, scale: float = 1.0, normalise: bool = True) -> DataFrame:
    """(key, idx, value) of the merge of models' values (key, idx, model, value): trim, elect signs, average what agrees.

    The sign of an idx is that of the weighted sum of its models; the merged value is the weighted mean of the values
    of that sign (their weighted sum, unless ``normalise``), times ``scale``; 0 where none is left or they cancel out.
    """
    weighted = marked(parts, key, model, density).select(key, "idx", F.when(F.col("stays"), F.col("value")).alias("value"), weight.alias("_w"))
    v = F.col("value") * F.col("_w")
    up, down = F.col("value") > 0, F.col("value") < 0
    sums = weighted.groupBy(key, "idx").agg(
        F.sum(v).alias("_all"), F.sum(F.when(up, v)).alias("_up"), F.sum(F.when(down, v)).alias("_down"),
        F.sum(F.when(up, F.col("_w"))).alias("_up_w"), F.sum(F.when(down, F.col("_w"))).alias("_down_w"),
    )
    total = F.when(F.col("_all") > 0, F.col("_up")).when(F.col("_all") < 0, F.col("_down")).otherwise(0.0)
    weights = F.when(F.col("_all") > 0, F.col("_up_w")).otherwise(F.col("_down_w"))
    value = total / F.when(weights.isNull() | (weights == 0), 1.0).otherwise(weights) if normalise else total
    return sums.select(key, "idx", (value * scale).alias("value"))


def cleaned_keys(parts: DataFrame, key: str = "key") -> DataFrame:
    """Weights under the names that they are loaded by. Of names that become one, values of saved modules go before
    plain ones, and those before originals. Only names are compared, before any value moves."""
    raw = F.col(key)
    name = F.replace(F.replace(raw, F.lit(".modules_to_save"), F.lit("")), F.lit(".original_module"), F.lit(""))
    rank = F.when(raw.contains(".modules_to_save"), 3).when(raw.contains(".original_module"), 1).otherwise(2)
    names = parts.select(key).distinct().select(raw.alias("_raw"), name.alias("_name"), rank.alias("_rank"))
    best = names.groupBy("_name").agg(F.max_by("_raw", F.struct("_rank", F.col("_raw"))).alias("_raw"))
    return parts.join(F.broadcast(best), parts[key] == best["_raw"]).withColumn(key, F.col("_name")).select(*parts.columns)


def merge_files(models: dict[str, DataFrame], weights: dict[str, float], density: float, scale: float = 1.0) -> DataFrame:
    """Merge of models' weights, as ``sources.readers.tensor_rows`` gives them: names cleaned, whole embedding tensors
    untrimmed. A key must be in all models; one that is not is an error that names it."""
    parts = None
    for name, rows in models.items():
        rows = cleaned_keys(rows).withColumn("model", F.lit(name))
        parts = rows if parts is None else parts.unionByName(rows)
    missing = parts.groupBy("key").agg(F.count_distinct("model").alias("n")).filter(F.col("n") < len(models)).limit(1).collect()
    if missing:
        raise ValueError(f"not in all models: {missing[0]['key']}")
    weight = F.element_at(F.create_map(*(x for name, w in weights.items() for x in (F.lit(name), F.lit(float(w))))), F.col("model"))
    return ties_merge(parts, "key", "model", weight, density_of("key", density), scale)
