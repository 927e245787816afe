"""Seeded order, splits, caps and quotas: deterministic in any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions.storage import stored


#: Rows of a range of keys, about; at least as many ranges as the session has shuffle partitions.
RANGE_ROWS = 1 << 21


def _ranged(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows in the order, stored, with _part, the number of the range of keys that a row is in, and _in, its place there.

    The number of ranges follows the input. Equal keys are in one range.
    """
    ranges = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // RANGE_ROWS))
    sorted_ = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    # within a partition these ids rise by one
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return stored(sorted_.withColumns({"_part": F.spark_partition_id(), "_in": place}))


def numbered(rows: DataFrame, name: str, *order: str) -> tuple[DataFrame, int]:
    """The rows in the order, with the place of each, from 0; also returns the number of rows.

    Each range of keys is numbered by itself, from the count of the rows before it, so no task holds all of
    them. All columns of rows are sorted and stored: number keys, and join what is wide.
    """
    held = _ranged(rows, list(order))
    counts = dict(held.groupBy("_part").count().collect())
    starts, total = [], 0
    for part in sorted(counts):
        starts.append((part, total))
        total += counts[part]
    first = rows.sparkSession.createDataFrame(starts, "_part int, _first long")  # a row for a range
    return held.join(F.broadcast(first), "_part").withColumn(name, F.col("_first") + F.col("_in")).drop("_part", "_in", "_first"), total


def offset(rows: DataFrame, skip: int, *order: str) -> DataFrame:
    """The rows behind the first ``skip`` ones of the order, in that order; no task holds all of them."""
    placed, _ = numbered(rows, "_place", *order)
    return placed.filter(F.col("_place") >= skip).select(*rows.columns)


def running(rows: DataFrame, group: str, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """Adds running sums within each group, the row itself included; the order must be unique within a group.

    Sums run within ranges of keys, from the totals of the group's ranges before: no task holds a whole group.
    """
    ranged = _ranged(rows.withColumn("_g", _group_key(group)), ["_g", *order])
    totals = ranged.groupBy("_g", "_part").agg(*(F.sum(c).alias(f"_t_{name}") for name, c in sums.items()))
    before = Window.partitionBy("_g").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_g", "_part", *(F.coalesce(F.sum(f"_t_{name}").over(before), F.lit(0)).alias(f"_s_{name}") for name in sums))
    inside = Window.partitionBy("_g", "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    here = ranged.withColumns({f"_h_{name}": F.sum(c).over(inside) for name, c in sums.items()}).join(starts, ["_g", "_part"])
    return here.select(*(F.col(c) for c in rows.columns), *((F.col(f"_h_{name}") + F.col(f"_s_{name}")).alias(name) for name in sums))


def _group_key(group: str) -> Column:
    """A group's value as a string; a null is a group too."""
    return F.concat(F.when(F.col(group).isNull(), "n").otherwise("v"), F.coalesce(F.col(group).cast("string"), F.lit("")))


def shuffled(rows: DataFrame, seed, *keys: str) -> DataFrame:
    return rows.orderBy(X.seeded_hash(seed, *keys), *keys)


#: Leading hex digits of a hash that make a cell: a group of any size is ranked in 4096 parts.
CELL_DIGITS = 3


def _ranked(rows: DataFrame, group: str, seed, keys) -> DataFrame:
    """Adds _n, the size of the row's group, and _rank, its place in the group's seeded order, from 1.

    Rows are ranked within cells of their hash, from the number of rows in the cells before: counts travel, and
    no task holds a whole group.
    """
    hashed = rows.withColumn("_h", X.seeded_hash(seed, *keys)).withColumn("_g", _group_key(group)).withColumn("_cell", F.substr("_h", F.lit(1), F.lit(CELL_DIGITS)))
    cells = hashed.groupBy("_g", "_cell").agg(F.count("*").alias("_c"))
    whole = Window.partitionBy("_g")
    cells = cells.select("_g", "_cell", F.sum("_c").over(whole).alias("_n"), (F.sum("_c").over(whole.orderBy("_cell")) - F.col("_c")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_g", "_cell").orderBy("_h", *keys))
    return hashed.withColumn("_r", within).join(cells, ["_g", "_cell"]).withColumn("_rank", F.col("_before") + F.col("_r")).drop("_g", "_cell", "_h", "_r", "_before")


def ranked(rows: DataFrame, group: str, seed, *keys: str) -> DataFrame:
    """Adds rank: the place in the seeded order of the row's group, from 1."""
    return _ranked(rows, group, seed, keys).drop("_n").withColumnRenamed("_rank", "rank")


def stratified_split(rows: DataFrame, group: str, fraction: float, seed, *keys: str) -> DataFrame:
    """Adds split (dev or train): of each group round(n * fraction) to dev, at least 1 and not all; groups of
    one, and fraction 0, give none."""
    dev = F.least(F.greatest(F.lit(1), F.bround(F.col("_n") * F.lit(float(fraction))).cast("long")), F.col("_n") - 1)
    dev = F.when((F.col("_n") <= 1) | (F.lit(float(fraction)) <= 0), F.lit(0)).otherwise(dev)
    return _ranked(rows, group, seed, keys).withColumn("split", F.when(F.col("_rank") <= dev, "dev").otherwise("train")).drop("_n", "_rank")


def ratio_split(rows: DataFrame, group: str, train: float, dev: float, test: float, seed, *keys: str) -> DataFrame:
    """Adds split: floors of the ratios to train and dev, the rest to test; groups of 10 and more have all three."""
    if abs(train + dev + test - 1.0) > 1e-8:
        raise ValueError("ratios must sum to 1")
    n = F.col("_n")
    n_train, n_dev = F.floor(n * F.lit(train)), F.floor(n * F.lit(dev))
    large = n >= 10
    n_train = F.when(large, F.greatest(n_train, F.lit(1))).otherwise(n_train)
    n_dev = F.when(large, F.greatest(n_dev, F.lit(1))).otherwise(n_dev)
    n_train = F.when(large & (n - n_train - n_dev < 1), n_train - 1).otherwise(n_train)
    split = F.when(F.col("_rank") <= n_train, "train").when(F.col("_rank") <= n_train + n_dev, "dev").otherwise("test")
    return _ranked(rows, group, seed, keys).withColumn("split", split).drop("_n", "_rank")


def fixed_split(rows: DataFrame, n_dev: int, n_test: int, seed, *keys: str) -> DataFrame:
    """Adds split: the first rows of the seeded order to dev, the next to test, all others to train.

    Only dev and test are sorted (a top-k), so no task ranks the whole table; keys must be unique.
    """
    head = shuffled(rows, seed, *keys).limit(n_dev + n_test).select(*keys)
    place = F.row_number().over(Window.orderBy(X.seeded_hash(seed, *keys), *keys))
    held = head.withColumn("split", F.when(place <= n_dev, "dev").otherwise("test"))
    return rows.join(held, list(keys), "left").withColumn("split", F.coalesce("split", F.lit("train")))


def hash_split(rows: DataFrame, parts: int, seed, *keys: str) -> DataFrame:
    """Adds split: test for one in ``parts`` rows by hash, else train; no shuffle."""
    return rows.withColumn("split", F.when(X.seeded_index(parts, seed, *keys) == 0, "test").otherwise("train"))


def capped(rows: DataFrame, keep: Column, key, cap: int, seed, *order: str) -> tuple[DataFrame, DataFrame]:
    """(kept, loaded): rows in seeded order that pass ``keep`` and are first of their key, up to ``cap``; and how
    many rows had been read when the last of them was kept."""
    hashed = rows.withColumn("_h", X.seeded_hash(seed, *order)).withColumn("_key", F.sha2(key, 256))
    passing = hashed.filter(keep)
    first = passing.withColumn("_p", F.row_number().over(Window.partitionBy("_key").orderBy("_h", *order))).filter("_p = 1")
    kept = first.orderBy("_h", *order).limit(cap)
    last = kept.agg(F.max("_h").alias("_last"), F.count("*").alias("_kept"))
    loaded = hashed.crossJoin(F.broadcast(last)).agg(F.count_if((F.col("_kept") < cap) | (F.col("_h") <= F.col("_last"))).alias("loaded"))
    return kept.drop("_h", "_key", "_p"), loaded


def quota(rows: DataFrame, category: str, most: int, order: list) -> DataFrame:
    """The first rows of each category, numbered category_001 and so on."""
    place = F.row_number().over(Window.partitionBy(category).orderBy(*order))
    numbered = rows.withColumn("_place", place).filter(F.col("_place") <= most)
    return numbered.withColumn("item", F.format_string("%s_%03d", category, "_place")).drop("_place")


def quota_rounds(candidates, categories: list[str], most: int, key: list[str], order: list[str], rounds: int = 8) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): of each category in turn the first ``most`` candidates without errors whose key no
    candidate accepted before has, whatever its category.

    candidates(category, round) gives the rows of a round, with a column ``errors`` (an array) and unique order
    columns; a category that is still short after a round asks for another one, up to ``rounds``, and an empty round
    ends it. Accepted rows get ``item``, category_001 and so on; rejected ones, of those that were looked at before the
    category was full, get ``reason``: their errors, or "duplicate minimal pair". Both have category and round. The
    driver sees one count a round; keys are compared as digests.
    """
    from .dedup import digest

    accepted = rejected = None
    for category in categories:
        held = 0
        for k in range(1, rounds + 1):
            rows = candidates(category, k).withColumns({"category": F.lit(category), "round": F.lit(k), "_key": digest(key)})
            good = F.size("errors") == 0
            seen = rows.withColumn("_seen", F.lit(False)) if accepted is None else rows.join(accepted.select("_key").distinct().withColumn("_old", F.lit(True)), "_key", "left").withColumn("_seen", F.col("_old").isNotNull()).drop("_old")
            first = F.row_number().over(Window.partitionBy("_key", good & ~F.col("_seen")).orderBy(*order))
            judged = stored(seen.withColumn("_new", good & ~F.col("_seen") & (first == 1)))
            wanted = judged.filter("_new").orderBy(*order).limit(most - held)  # a bounded number
            place = F.row_number().over(Window.orderBy(*order))
            taken = stored(wanted.withColumn("item", F.format_string("%s_%03d", F.lit(category), place + held)).drop("_seen", "_new"))
            n = taken.count()
            last = taken.agg(F.max(F.struct(*order)).alias("_last"))
            looked = judged.filter("NOT _new").drop("_new")
            if held + n >= most:
                looked = looked.crossJoin(F.broadcast(last)).filter(F.struct(*order) <= F.col("_last")).drop("_last")
            reason = F.when(F.size("errors") > 0, F.array_join("errors", "; ")).otherwise("duplicate minimal pair")
            refused = looked.withColumn("reason", reason).drop("_seen", "_key")
            accepted = taken if accepted is None else accepted.unionByName(taken)
            rejected = refused if rejected is None else rejected.unionByName(refused)
            held += n
            if held >= most or judged.isEmpty():
                break
    return accepted.drop("_key"), rejected
