"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard.

Every vector is indexed in the shard that its id hashes to; the shards grow with the table, up to a size that
a worker holds. A shard's graph is kept as flat arrays (the neighbours of all nodes, layer by layer), written
to a table, and searched by blocks of queries; the results of all shards are merged. Vectors that are equal
component by component are one node with a list of ids. Nodes find their links by searching the graph of the
nodes that entered before them, many searches in step.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Vectors of a shard: this share of the table, but at least SHARD_ROWS and at most what SHARD_BYTES hold in
#: single precision. Links of a node above layer 0 (twice as many in it); candidates kept while building and
#: searching; vectors in a block of queries; blocks that one search task takes.
SHARD_SHARE = 1 / 64
SHARD_ROWS = 8192
SHARD_BYTES = 32 << 20
LINKS = 24
BUILD_WIDTH = 96
SEARCH_WIDTH = 128
QUERY_BLOCK = 1024
BLOCKS_A_TASK = 64
#: Nodes that a search expands at a time; marks of visited nodes that searches in step hold together.
EXPANDED = 4
VISITED_BYTES = 16 << 20
#: Nodes that enter a graph together.
ENTERING = 512
SEED = 7


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of one vector with rows of b, in double precision."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    return (b * a).sum(axis=1) / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum(axis=1)))


def _diverse(candidates: np.ndarray, near: np.ndarray, units: np.ndarray, most: int) -> np.ndarray:
    """The heuristic choice of links: nearest first, skipping what is nearer to a chosen link than to the
    node itself; places left go to the nearest of the skipped."""
    if len(candidates) <= most:
        return candidates
    between = units[candidates] @ units[candidates].T
    chosen: list[int] = []
    covered = np.full(len(candidates), -2.0, np.float32)
    for k in range(len(candidates)):
        if covered[k] <= near[k]:
            chosen.append(k)
            if len(chosen) == most:
                break
            np.maximum(covered, between[k], out=covered)
    if len(chosen) < most:
        taken = set(chosen)
        chosen += [k for k in range(len(candidates)) if k not in taken][: most - len(chosen)]
    return candidates[chosen]


def _descend(units: np.ndarray, row: np.ndarray, flat: np.ndarray, queries: np.ndarray, here: np.ndarray) -> np.ndarray:
    """The node of one layer at which each query's walk to ever nearer neighbours ends."""
    here = here.copy()
    best = np.einsum("qd,qd->q", queries, units[here])
    open_ = np.arange(len(queries))
    while len(open_):
        around = flat[row[here[open_]]]
        closeness = np.einsum("qd,qmd->qm", queries[open_], units[around])
        closeness[around < 0] = -np.inf
        k = closeness.argmax(axis=1)
        nearest = closeness[np.arange(len(open_)), k]
        better = nearest > best[open_]
        at = open_[better]
        here[at], best[at] = around[better, k[better]], nearest[better]
        open_ = at
    return here


def _explore(units: np.ndarray, row: np.ndarray, flat: np.ndarray, queries: np.ndarray, here: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Of one layer, the ``width`` nodes nearest to each query that a search from ``here`` finds, nearest first,
    and their closeness (padded with -1 and -inf). All queries take their steps together."""
    n = len(queries)
    seen = np.zeros((n, len(units) + 1), bool)  # the last column takes the padding
    seen[:, -1] = True
    seen[np.arange(n), here] = True
    nodes = np.full((n, width), -1, np.int64)
    close = np.full((n, width), -np.inf, np.float32)
    done = np.ones((n, width), bool)
    nodes[:, 0], close[:, 0], done[:, 0] = here, np.einsum("qd,qd->q", queries, units[here]), False
    open_ = np.arange(n)
    while len(open_):
        waiting = np.where(done[open_], -np.inf, close[open_])
        take = min(EXPANDED, width)
        pick = np.argpartition(-waiting, take - 1, axis=1)[:, :take]
        chosen = np.where(np.take_along_axis(waiting, pick, 1) > -np.inf, np.take_along_axis(nodes[open_], pick, 1), -1)
        done[open_[:, None], pick] = True
        around = np.where(chosen[:, :, None] >= 0, flat[row[chosen]], -1).reshape(len(open_), -1)
        around.sort(axis=1)
        around[:, 1:][around[:, 1:] == around[:, :-1]] = -1
        new = ~seen[open_[:, None], around]
        seen[open_[:, None], around] = True
        closeness = np.einsum("qd,qmd->qm", queries[open_], units[around])
        closeness[~new] = -np.inf
        all_close = np.concatenate([close[open_], closeness], axis=1)
        best = np.argpartition(-all_close, width - 1, axis=1)[:, :width]
        close[open_] = np.take_along_axis(all_close, best, 1)
        nodes[open_] = np.take_along_axis(np.concatenate([nodes[open_], around], axis=1), best, 1)
        done[open_] = np.take_along_axis(np.concatenate([done[open_], ~new], axis=1), best, 1)
        open_ = open_[~done[open_].all(axis=1)]
    order = np.argsort(-close, axis=1, kind="stable")
    return np.take_along_axis(nodes, order, 1), np.take_along_axis(close, order, 1)


class Graph:
    """Layers of links over unit vectors; layer l holds the nodes whose level is at least l.

    links[l] is a flat array of node numbers, width[l] for each node (padded with -1); row[l] gives a node's
    place in it. Nodes enter in small groups: each searches the layers from the top for the nodes nearest to it,
    among all that entered before, and sees those of its own group besides.
    """

    def __init__(self, units: np.ndarray, links: int = LINKS, width: int = BUILD_WIDTH, seed: int = SEED):
        n = len(units)
        self.units = units.astype(np.float32)
        rng = np.random.default_rng(seed)
        levels = np.minimum(np.floor(-np.log(1 - rng.random(n)) / math.log(links)).astype(int), 8)
        top = int(levels.max(initial=0))
        self.layers: list[tuple[np.ndarray, np.ndarray]] = []  # row of each node (or -1), flat links
        for layer in range(top + 1):
            members = np.flatnonzero(levels >= layer)
            row = np.full(n, -1, np.int32)
            row[members] = np.arange(len(members))
            self.layers.append((row, np.full((len(members), links * 2 if layer == 0 else links), -1, np.int32)))
        self.entry = 0 if n else -1
        done = 0
        while done < n:
            stop = min(n, done + max(1, min(ENTERING, done)))
            self._enter(np.arange(done, stop), levels, width)
            done = stop

    def _enter(self, group: np.ndarray, levels: np.ndarray, width: int) -> None:
        before = int(group[0])
        reached = int(levels[self.entry]) if before else -1
        queries = self.units[group]
        here = np.full(len(group), self.entry)
        for layer in range(len(self.layers) - 1, -1, -1):
            row, flat = self.layers[layer]
            entering = levels[group] >= layer
            near, close = np.zeros((len(group), 0), np.int64), np.zeros((len(group), 0), np.float32)
            if layer <= reached:
                if entering.any():
                    near = np.full((len(group), width), -1, np.int64)
                    close = np.full((len(group), width), -np.inf, np.float32)
                    near[entering], close[entering] = _explore(self.units, row, flat, queries[entering], here[entering], width)
                    here[entering] = near[entering, 0]
                if not entering.all():
                    here[~entering] = _descend(self.units, row, flat, queries[~entering], here[~entering])
            if entering.any():
                self._link(layer, group[entering], near[entering], close[entering], width)
        tallest = int(group[levels[group].argmax()])
        if not before or levels[tallest] > levels[self.entry]:
            self.entry = tallest

    def _link(self, layer: int, group: np.ndarray, near: np.ndarray, close: np.ndarray, width: int) -> None:
        row, flat = self.layers[layer]
        most, units = flat.shape[1], self.units
        among = units[group] @ units[group].T
        np.fill_diagonal(among, -np.inf)
        near = np.concatenate([near, np.broadcast_to(group, among.shape)], axis=1)
        close = np.concatenate([close, among], axis=1)
        order = np.argsort(-close, axis=1, kind="stable")[:, :width]
        near, close = np.take_along_axis(near, order, 1), np.take_along_axis(close, order, 1)
        incoming: dict[int, list[int]] = {}
        for node, found, closeness in zip(group.tolist(), near, close):
            held = closeness > -np.inf
            chosen = _diverse(found[held], closeness[held], units, most // 2)
            flat[row[node], : len(chosen)] = chosen
            for j in chosen.tolist():
                incoming.setdefault(j, []).append(node)
        for j, sources in incoming.items():
            own = flat[row[j]]
            merged = np.unique(np.concatenate([own[own >= 0], np.array(sources, np.int64)]))
            if len(merged) > most:
                closeness = units[merged] @ units[j]
                order = np.argsort(-closeness, kind="stable")
                merged = _diverse(merged[order], closeness[order], units, most)
            flat[row[j]] = -1
            flat[row[j], : len(merged)] = merged

    def search(self, queries: np.ndarray, width: int = SEARCH_WIDTH) -> tuple[np.ndarray, np.ndarray]:
        """Up to ``width`` nodes near each unit vector, nearest first, and their closeness (padded with -1, -inf)."""
        queries = queries.astype(np.float32)
        together = max(16, VISITED_BYTES // (len(self.units) + 1))
        found = []
        for at in range(0, len(queries), together):
            part = queries[at : at + together]
            here = np.full(len(part), self.entry)
            for row, flat in reversed(self.layers[1:]):
                here = _descend(self.units, row, flat, part, here)
            found.append(_explore(self.units, *self.layers[0], part, here, width))
        return np.concatenate([f for f, _ in found]), np.concatenate([c for _, c in found])

    def pack(self) -> tuple[bytes, bytes, list[int]]:
        """rows and links of all layers as flat 32-bit arrays, and each layer's width."""
        return b"".join(r.tobytes() for r, _ in self.layers), b"".join(f.tobytes() for _, f in self.layers), [self.entry, *(f.shape[1] for _, f in self.layers)]

    @classmethod
    def unpack(cls, units: np.ndarray, rows: bytes, links: bytes, shape: list[int]) -> Graph:
        graph = cls.__new__(cls)
        graph.units, graph.entry, graph.layers = units.astype(np.float32), shape[0], []
        row_array, link_array = np.frombuffer(rows, np.int32), np.frombuffer(links, np.int32)
        at = 0
        for k, most in enumerate(shape[1:]):
            row = row_array[k * len(units) : (k + 1) * len(units)]
            size = int((row >= 0).sum()) * most
            graph.layers.append((row, link_array[at : at + size].reshape(-1, most)))
            at += size
        return graph


INDEX = "shard int, dim int, vectors binary, ids binary, id_starts binary, rows binary, links binary, shape array<int>"


def _valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    vector = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    ok = F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("vector", lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("id"), vector.alias("vector")).filter(ok & F.col("id").isNotNull())


def shard_rows(n: int, dim: int) -> int:
    """Vectors of a shard of a table with n rows."""
    return int(min(max(SHARD_ROWS, n * SHARD_SHARE), max(SHARD_ROWS, SHARD_BYTES // (4 * max(dim, 1)))))


def build_index(vectors: DataFrame, scratch: Scratch) -> DataFrame:
    """A stored table with a row per shard and dimension: vectors, ids and graph as flat arrays.

    vectors: rows (id, vector). Within a shard, vectors that are equal component by component are one node.
    """
    n, dim = vectors.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    shards = max(1, math.ceil(n / shard_rows(n, dim or 1)))

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        shard, dim = key
        rows = rows.sort_values("id", kind="stable")
        ids = rows["id"].to_numpy(np.int64)
        stacked = np.stack(rows["vector"].to_numpy()).astype(np.float64)
        _, first, inverse = np.unique(stacked, axis=0, return_index=True, return_inverse=True)
        order = np.argsort(inverse.ravel(), kind="stable")  # ids of a node stay in rising order
        starts = np.concatenate([[0], np.cumsum(np.bincount(inverse.ravel(), minlength=len(first)))]).astype(np.int64)
        distinct = stacked[first]
        packed = Graph(_unit(distinct)).pack()
        return pd.DataFrame([(shard, dim, distinct.tobytes(), ids[order].tobytes(), starts.tobytes(), packed[0], packed[1], packed[2])],
                            columns=["shard", "dim", "vectors", "ids", "id_starts", "rows", "links", "shape"])

    placed = vectors.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), F.size("vector").alias("dim"), "id", "vector")
    return scratch.store(placed.groupBy("shard", "dim").applyInPandas(build, INDEX), "index")


def search_index(index: DataFrame, queries: DataFrame, scratch: Scratch, k: int = 5, width: int = SEARCH_WIDTH) -> DataFrame:
    """The k nearest of each query: query_id, rank, vec_id, score. queries: rows (id, vector).

    A query's own id is no answer. Queries travel in blocks, one copy for each shard of their dimension; a
    task holds one shard and a bounded number of blocks.
    """
    total, shards = queries.count(), index.agg(F.max("shard")).first()[0]
    shards = 1 if shards is None else shards + 1
    blocks = max(1, math.ceil(total / QUERY_BLOCK))
    teams = max(1, math.ceil(blocks / BLOCKS_A_TASK))

    def block(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        packed = np.stack(rows["vector"].to_numpy()).astype(np.float64).tobytes()
        return pd.DataFrame([(key[0], key[1], rows["id"].to_numpy(np.int64).tobytes(), packed)], columns=["block", "dim", "query_ids", "query_vectors"])

    numbered = queries.select(F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(blocks)).cast("int").alias("block"), F.size("vector").alias("dim"), "id", "vector")
    blocked = scratch.store(numbered.groupBy("block", "dim").applyInPandas(block, "block int, dim int, query_ids binary, query_vectors binary"), "queries")
    team = F.pmod("block", F.lit(teams)).cast("int").alias("team")
    shard = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    sent = blocked.select("dim", team, "query_ids", "query_vectors", shard)
    indexed = index.withColumn("team", F.explode(F.sequence(F.lit(0), F.lit(teams - 1))))

    def search(key: tuple, shard: pd.DataFrame, sent: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(shard) and len(sent):
            s = shard.iloc[0]
            exact = np.frombuffer(s["vectors"], np.float64).reshape(-1, s["dim"])
            ids, starts = np.frombuffer(s["ids"], np.int64), np.frombuffer(s["id_starts"], np.int64)
            graph = Graph.unpack(_unit(exact), s["rows"], s["links"], list(s["shape"]))
            for query_ids, packed in zip(sent["query_ids"], sent["query_vectors"]):
                wanted = np.frombuffer(packed, np.float64).reshape(-1, s["dim"])
                units = _unit(wanted).astype(np.float32)
                for own, vector, nodes in zip(np.frombuffer(query_ids, np.int64), wanted, graph.search(units, width)[0]):
                    nodes = nodes[nodes >= 0]
                    scores = cosine(vector, exact[nodes])
                    answers: list[tuple[float, int]] = []
                    for i in np.argsort(-scores, kind="stable"):
                        if len(answers) >= k and scores[i] < answers[k - 1][0]:
                            break
                        same = ids[starts[nodes[i]] : starts[nodes[i] + 1]][: k + 1]
                        answers += [(float(scores[i]), int(x)) for x in same if x != own]
                    answers.sort(key=lambda a: (-a[0], a[1]))
                    out += [(int(own), x, score) for score, x in answers[:k]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    found = indexed.groupBy("shard", "dim", "team").cogroup(sent.groupBy("shard", "dim", "team")).applyInPandas(search, "query_id long, vec_id long, score double")
    # Spark keeps the first k of each query before it shuffles, so the merge is bounded in each task
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5) -> DataFrame:
    """The k nearest vectors, by cosine, of each row that ``is_query`` (a condition on ``id``) selects.

    Rows whose vector is null, zero, or holds null or non-finite components, and rows without an id, take
    no part. Vectors meet only others of their dimension. Fewer candidates than k are all returned. Ties go
    to the smaller id; repeated vectors all count as candidates. An empty table gives no rows. Other columns,
    whatever their names, are not looked at. The index holds every row; nothing is fitted on a sample.
    """
    scratch = Scratch(vectors.sparkSession, "neighbours")
    valid = scratch.store(_valid(vectors, id_col, vector_col), "vectors")
    index = build_index(valid, scratch)
    return search_index(index, valid.filter(is_query), scratch, k)


def query(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 50 == 0)
