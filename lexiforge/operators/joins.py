"""Joins and unions of record sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions.storage import stored
from . import sampling


def tagged_union(sources: dict[str, DataFrame], tag: str, rank: str | None = None) -> DataFrame:
    """All rows, with the name of their source (and its place in the order); missing columns are null."""
    parts = []
    for k, (name, rows) in enumerate(sources.items()):
        rows = rows.withColumn(tag, F.lit(name))
        parts.append(rows.withColumn(rank, F.lit(k)) if rank else rows)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def reply_pairs(messages: DataFrame, key: str, parent: str, text: str, ask: Column, reply: Column) -> DataFrame:
    """(key, instruction, output): replies with the message that they answer; without one they go.

    Of repeated keys, a parent is one row: the last by text, so a join never multiplies replies.
    """
    asked = messages.filter(ask).groupBy(F.col(key).alias("_key")).agg(F.max(text).alias("instruction"))
    replies = messages.filter(reply).select(F.col(key), F.col(parent).alias("_key"), F.col(text).alias("output"))
    return replies.join(asked, "_key").drop("_key")


def aligned(parts: dict[str, DataFrame], ordinal: str, check: bool = True) -> DataFrame:
    """Line-aligned parts side by side, by ordinal. With ``check`` a missing line raises an error."""
    out = reduce(lambda a, b: a.join(b, ordinal, "full_outer"), (rows.select(ordinal, F.col(rows.columns[-1]).alias(name)) for name, rows in parts.items()))
    if not check:
        return out
    whole = reduce(lambda a, b: a & b, (F.col(name).isNotNull() for name in parts))
    guarded = F.when(whole, F.col(ordinal)).otherwise(F.raise_error(F.concat(F.lit("parts differ at line "), F.col(ordinal).cast("string"))))
    return out.withColumn(ordinal, guarded.cast(out.schema[ordinal].dataType))


def fallback_lookup(rows: DataFrame, key: str, known: DataFrame, known_key: str, value: str, normal: Column) -> DataFrame:
    """Adds value: by the key itself, else by its normal form; null for misses."""
    direct = known.select(F.col(known_key).alias("_direct"), F.col(value).alias("_a"))
    other = known.select(F.col(known_key).alias("_other"), F.col(value).alias("_b"))
    found = rows.join(direct, F.col(key) == F.col("_direct"), "left").join(other, normal == F.col("_other"), "left")
    return found.withColumn(value, F.coalesce("_a", "_b")).drop("_direct", "_other", "_a", "_b")


def not_done(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key has no result yet."""
    return rows.join(done.select(key), key, "left_anti")


#: Sets of which all pairs are made have at most so many rows.
MOST_PAIRED = 10_000


def ordered_pairs(items: DataFrame, name: str, order: str) -> DataFrame:
    """All pairs of a small set, each once, the earlier first. A set of more than MOST_PAIRED rows raises an error."""
    if items.limit(MOST_PAIRED + 1).count() > MOST_PAIRED:
        raise ValueError(f"pairs of more than {MOST_PAIRED} rows")
    left = items.select(F.col(name).alias("left"), F.col(order).alias("_l"))
    right = items.select(F.col(name).alias("right"), F.col(order).alias("_r"))
    return left.join(F.broadcast(right), F.col("_l") < F.col("_r")).drop("_l", "_r")


def marker_counts(rows: DataFrame, text: str, markers: dict[str, list[str]]) -> DataFrame:
    """How many words of the text are in each marker list; repeats count."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b[\w']+\b"), F.lit(0))
    rows = rows.withColumn("_words", found)
    for name, listed in markers.items():
        rows = rows.withColumn(name, F.size(F.filter("_words", lambda w: w.isin(listed))).cast("long"))
    return rows.drop("_words")


def code_switched(rows: DataFrame, lang: str, text: str, key: str, pairs: list[tuple[str, str]], target: int, seed) -> DataFrame:
    """Texts of one language with a segment of another put in: attempts in seeded order, first of equal results, up to
    ``target``.

    An attempt picks a language pair, an anchor, a donor, a donor segment and a place; it fails if the anchor
    has under two segments or the donor none. There are at most max(30 * target, 100) attempts; no more are made than
    the target needs, about. Keys are unique. Keys are numbered and picked first; only texts that attempts have
    picked are split, each once.
    """
    most = max(30 * target, 100)
    chosen = rows.filter(F.col(lang).isin(sorted({x for p in pairs for x in p})))
    numbered, _ = sampling.numbered(chosen.select(F.col(lang).alias("_lang"), F.col(key).alias("_key")), "_row", "_lang", "_key")
    sizes = {r["_lang"]: (r["_first"], r["_n"]) for r in numbered.groupBy("_lang").agg(F.count("*").alias("_n"), F.min("_row").alias("_first")).collect()}
    tries = target + target // 2 + 16
    while True:
        made = _switched(chosen, numbered, sizes, text, key, pairs, min(tries, most), seed)
        if tries >= most or made.count() >= target:
            placed, _ = sampling.numbered(made.select("attempt"), "_place", "attempt")
            return made.join(placed.filter(F.col("_place") < target).select("attempt"), "attempt", "left_semi")
        tries *= 2


def _switched(chosen: DataFrame, numbered: DataFrame, sizes: dict[str, tuple[int, int]], text: str, key: str, pairs: list[tuple[str, str]], tries: int, seed) -> DataFrame:
    """The distinct results of the first ``tries`` attempts, stored."""
    spark = chosen.sparkSession
    pick = X.seeded_index(len(pairs), seed, F.lit("pair"), F.col("attempt")).cast("int")
    option = F.get(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), *(F.lit(x).cast("long").alias(n) for n, x in zip(("af", "an", "df", "dn"), (*sizes.get(a, (0, 0)), *sizes.get(b, (0, 0)))))) for a, b in pairs)), pick)
    attempts = spark.range(tries).withColumnRenamed("id", "attempt").withColumn("_o", option).filter("_o.an > 0 AND _o.dn > 0")
    anchor_row = F.col("_o.af") + X.seeded_index(F.col("_o.an"), seed, F.lit("anchor"), "attempt")
    donor_row = F.col("_o.df") + X.seeded_index(F.col("_o.dn"), seed, F.lit("donor"), "attempt")
    placed = attempts.select("attempt", F.col("_o.a").alias("anchor_lang"), F.col("_o.b").alias("inserted_lang"), anchor_row.alias("_ar"), donor_row.alias("_dr"))
    placed = placed.join(numbered.select(F.col("_row").alias("_ar"), F.col("_key").alias("anchor")), "_ar")
    placed = stored(placed.join(numbered.select(F.col("_row").alias("_dr"), F.col("_key").alias("donor")), "_dr").drop("_ar", "_dr"))
    wanted = placed.select(F.explode(F.array("anchor", "donor")).alias("_key")).distinct()
    # stored before it is split: else what is asked of segments is asked of every text
    picked = stored(chosen.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(wanted, "_key", "left_semi"))
    picked = stored(picked.select("_key", X.segments("_text").alias("_s")))
    joined = placed.join(picked.select(F.col("_key").alias("anchor"), F.col("_s").alias("_a")), "anchor")
    joined = joined.join(picked.select(F.col("_key").alias("donor"), F.col("_s").alias("_d")), "donor").filter("size(_a) >= 2 AND size(_d) >= 1")
    joined = joined.withColumn("_di", X.seeded_index(F.size("_d"), seed, F.lit("segment"), "attempt").cast("int"))
    joined = joined.withColumn("insert_after_segment", (X.seeded_index(F.size("_a") - 1, seed, F.lit("place"), "attempt") + 1).cast("int"))
    mixed = F.concat(F.slice("_a", F.lit(1), F.col("insert_after_segment")), F.array(F.get("_d", F.col("_di"))), F.slice("_a", F.col("insert_after_segment") + 1, F.size("_a")))
    made = joined.select("attempt", "anchor", "donor", "anchor_lang", "inserted_lang", "insert_after_segment", F.array_join(mixed, " ").alias(text))
    first = F.row_number().over(Window.partitionBy(F.sha2(text, 256)).orderBy("attempt"))
    return stored(made.withColumn("_first", first).filter("_first = 1").drop("_first"))
