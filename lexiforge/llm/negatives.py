"""Hard negatives for contrastive training, by a full sort of each anchor's integer scores.

Vectors are quantised to integers, so a score is an exact integer. Rows are packed into shards by a hash of
their id, anchors into blocks. Every block meets every shard twice: once to find each anchor's positives, the
best rows of its own label; once, when the positives of all shards are merged, to sort the scores of the shard
for each anchor, find where each positive's upper limit falls by binary search, and read the rows of other
labels from there down to the lower limit. What shards find is merged by score and id.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: A component x becomes floor(SCALE * x).
SCALE = 256
POSITIVES = 5
NEGATIVES = 3
#: A negative's score, in hundredths of its positive's, lies between these.
LOWER, UPPER = 50, 95
#: Rows of a shard: this share of the table, but at least SHARD_ROWS and at most what SHARD_BYTES hold.
SHARD_SHARE = 1 / 64
SHARD_ROWS = 8192
SHARD_BYTES = 32 << 20
#: Anchors of a block; blocks that one task takes; bytes of scores that a task holds at a time.
BLOCK = 256
BLOCKS_A_TASK = 64
SCORE_BYTES = 16 << 20

PACKED = "ids binary, labels binary, vectors binary"


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = SCALE) -> DataFrame:
    """Rows (id, label, vector) that take part, with integer components.

    Rows with a null id or label, a null vector, or a null or non-finite component take no part.
    """
    number = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    whole = F.forall("number", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    found = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), number.alias("number"))
    return found.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("number").isNotNull() & whole).select(
        "id", "label", F.transform("number", lambda x: F.floor(x * F.lit(float(scale)))).alias("vector")
    )


def shard_rows(n: int, dim: int) -> int:
    """Rows of a shard of a table with n rows."""
    return int(min(max(SHARD_ROWS, n * SHARD_SHARE), max(SHARD_ROWS, SHARD_BYTES // (4 * max(dim, 1)))))


def _packed(rows: pd.DataFrame) -> tuple[bytes, bytes, bytes]:
    """Ids, labels and components of rows, by id and then label."""
    rows = rows.sort_values(["id", "label"], kind="stable")
    vectors = np.stack(rows["vector"].to_numpy()).astype(np.int64)
    if len(vectors) and np.abs(vectors).max(initial=0) >= 1 << 31:
        raise ValueError("a quantised component needs more than 32 bits")
    return rows["id"].to_numpy(np.int64).tobytes(), rows["label"].to_numpy(np.int64).tobytes(), vectors.astype(np.int32).tobytes()


def _pack(rows: DataFrame, number: str) -> DataFrame:
    """One packed row for each value of the column ``number`` and each dimension."""

    def pack(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(key[0], key[1], *_packed(group))], columns=[number, "dim", "ids", "labels", "vectors"])

    return rows.withColumn("dim", F.size("vector")).groupBy(number, "dim").applyInPandas(pack, f"{number} int, dim int, {PACKED}")


def _unpack(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
    return ids, labels, np.frombuffer(row["vectors"], np.int32).reshape(len(ids), -1)


def inner_products(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products of integer vectors, as 64-bit integers."""
    bound = int(np.abs(anchors).max(initial=0)) * int(np.abs(rows).max(initial=0)) * anchors.shape[1]
    if bound >= 1 << 63:
        raise ValueError("a score may need more than 64 bits")
    if bound < 1 << 53:  # sums of doubles are exact, and products of matrices fast
        return (anchors.astype(np.float64) @ rows.T.astype(np.float64)).astype(np.int64)
    return anchors.astype(np.int64) @ rows.T.astype(np.int64)


def _scored(anchors: np.ndarray, rows: np.ndarray):
    """(number of an anchor, its scores) for all anchors, a bounded number of scores at a time."""
    step = max(1, SCORE_BYTES // (8 * max(len(rows), 1)))
    for at in range(0, len(anchors), step):
        yield from enumerate(inner_products(anchors[at : at + step], rows), at)


def best_of_label(anchors: tuple, shard: tuple, most: int) -> list[tuple[int, int, int]]:
    """(anchor's place, row's id, score) of the first ``most`` rows of each anchor's label, the anchor's id left out."""
    ids, labels, vectors = shard
    out = []
    for label in np.unique(anchors[1]):
        places, same = np.flatnonzero(anchors[1] == label), np.flatnonzero(labels == label)
        if not len(same):
            continue
        for k, scores in _scored(anchors[2][places], vectors[same]):
            order = np.lexsort((ids[same], -scores))
            order = order[ids[same][order] != anchors[0][places[k]]][:most]
            out += [(int(places[k]), int(i), int(s)) for i, s in zip(ids[same][order], scores[order])]
    return out


def negatives_of(anchors: tuple, positives: dict[int, list[tuple[int, int, int]]], shard: tuple, most: int, lower: int = LOWER, upper: int = UPPER) -> list[tuple]:
    """(anchor's place, positive's number, negative's id, score): of each positive, the first ``most`` rows of other
    labels with lower * positive <= 100 * score <= upper * positive. positives: of an anchor's place, (number, id, score)."""
    ids, labels, vectors = shard
    out = []
    for place, scores in _scored(anchors[2], vectors):
        own = positives.get(place)
        if not own:
            continue
        order = np.lexsort((ids, -scores))
        order = order[(labels[order] != anchors[1][place]) & (ids[order] != anchors[0][place])]
        falling = -100 * scores[order]
        for number, _, score in own:
            first = int(np.searchsorted(falling, -upper * score, "left"))
            for i in order[first : first + most]:
                if 100 * int(scores[i]) < lower * score:
                    break
                out.append((place, number, int(ids[i]), int(scores[i])))
    return out


def _meet(shards: DataFrame, blocks: DataFrame, n_shards: int, n_blocks: int, meet, schema: str) -> DataFrame:
    """Every block with every shard of its dimension: meet(shard, block) gives tuples, to which block and dim are added.

    A task holds one shard and takes a bounded number of blocks one after another.
    """
    teams = max(1, math.ceil(n_blocks / BLOCKS_A_TASK))
    columns = [c.split()[0] for c in schema.split(", ")]
    shard = F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))).alias("shard")
    sent = blocks.select("*", F.pmod("block", F.lit(teams)).cast("int").alias("team"), shard)
    held = shards.withColumn("team", F.explode(F.sequence(F.lit(0), F.lit(teams - 1))))

    def run(key: tuple, shard: pd.DataFrame, sent: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(shard) and len(sent):
            rows = _unpack(shard.iloc[0])
            for _, block in sent.iterrows():
                out += [(block["block"], block["dim"], *found) for found in meet(rows, block)]
        return pd.DataFrame(out, columns=["block", "dim", *columns])

    keys = ("shard", "dim", "team")
    return held.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInPandas(run, f"block int, dim int, {schema}")


def mine(rows: DataFrame, is_anchor, positives: int = POSITIVES, negatives: int = NEGATIVES, lower: int = LOWER, upper: int = UPPER) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, for the anchors that the condition
    ``is_anchor`` on ``id`` selects. rows: (id, label, vector) as ``quantised`` returns them.

    Higher scores come first, ties by the smaller id. Positives are an anchor's first rows of its label, negatives
    of a positive the first rows of other labels within its limits; fewer are all returned, and a positive without
    a negative gives no row. Rows meet only rows of their dimension, and none of the anchor's id. Repeated rows
    count as often as they occur, as anchors too. An empty table gives no rows. Components of more than 32 bits
    and scores of more than 64 raise an error.
    """
    scratch = Scratch(rows.sparkSession, "negatives")
    rows = scratch.store(rows, "rows", F.max(F.size("vector")).alias("dim"), F.sum(F.when(is_anchor, 1).otherwise(0)).alias("anchors"))
    n_shards = max(1, math.ceil(rows.seen["n_rows"] / shard_rows(rows.seen["n_rows"], rows.seen["dim"] or 1)))
    n_blocks = max(1, math.ceil((rows.seen["anchors"] or 0) / BLOCK))
    shards = scratch.store(_pack(rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(n_shards)).cast("int")), "shard"), "shards")
    # by id and label too, so that rows that repeat an id do not pile up in one block
    block = F.pmod(F.xxhash64("id", "label", F.lit(SCALE)), F.lit(n_blocks)).cast("int")
    blocks = scratch.store(_pack(rows.filter(is_anchor).withColumn("block", block), "block"), "blocks")

    def first(shard, block):
        return best_of_label(_unpack(block), shard, positives)

    found = _meet(shards, blocks, n_shards, n_blocks, first, "place int, id long, score long")
    number = F.row_number().over(Window.partitionBy("block", "dim", "place").orderBy(F.desc("score"), "id"))
    chosen = found.withColumn("number", number).filter(F.col("number") <= positives)
    by_block = chosen.groupBy("block", "dim").agg(F.collect_list(F.struct("place", "number", "id", "score")).alias("positives"))
    blocks = scratch.store(blocks.join(by_block, ["block", "dim"]), "positives")

    def second(shard, block):
        anchors, own = _unpack(block), {}
        for p in block["positives"]:
            own.setdefault(p["place"], []).append((p["number"], p["id"], p["score"]))
        about = {(place, number): (int(anchors[0][place]), i, score) for place, ps in own.items() for number, i, score in ps}
        for place, number, i, score in negatives_of(anchors, own, shard, negatives, lower, upper):
            yield place, number, *about[place, number], i, score

    schema = "place int, number int, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
    found = _meet(shards, blocks, n_shards, n_blocks, second, schema)
    rank = F.row_number().over(Window.partitionBy("block", "dim", "place", "number").orderBy(F.desc("negative_score"), "negative_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def query(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(quantised(vectors.withColumn("label", moved)), F.col("id") % 50 == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS c
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.c, b.c) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.c) = len(b.c)),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
n AS (
  SELECT p.anchor_id, p.other_id AS positive_id, s.other_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY s.score DESC, s.other_id) AS place
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, CAST(place AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE place <= 3
"""
