"""Packing token sequences by cutting-stock column generation.

Documents are cut into full sequences and one rest each. The lengths of the rests form a histogram
of at most ``capacity - 1`` classes, however large the corpus, so the linear program over packing
patterns is solved on the driver: a knapsack dynamic program prices new patterns, the fractional
solution is rounded down, and what rounding leaves is packed best-fit. Most rests stay in one piece.
A few, the filler, are laid end to end and cut so that they fill the gaps that patterns leave; so
padding remains in the last sequence or few. The plan - runs of ranks of each length and where they
go - has a size bounded by the capacity and is joined to the ranked rests.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .common import Scratch, tidy

#: Tokens in a sequence, and the id that ends a document.
CAPACITY = 1024
EOS_ID = 0

PIECES = "id long, start long, length int, ids_crc32 long, ids binary, doc_tokens long, part int, ordinal long"
PLACED = "id long, start long, length int, ids_crc32 long, ids binary, doc_tokens long, sequence_id long, offset long"
PLAN = "plan_length int, first_rank long, last_rank long, copies int, first_sequence long, base int"


def _knapsack(lengths: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The pattern of largest value: unbounded knapsack over capacities, one vector step each."""
    best = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1)
    order = np.argsort(lengths)
    sizes, worth = lengths[order], values[order]
    counts = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        best[room], choice[room] = best[room - 1], -1
        k = counts[room]
        if k:
            total = best[room - sizes[:k]] + worth[:k]
            i = int(total.argmax())
            if total[i] > best[room] + 1e-12:
                best[room], choice[room] = total[i], i
    pattern = np.zeros(len(lengths))
    room = capacity
    while room > 0:
        if choice[room] < 0:
            room -= 1
        else:
            pattern[order[choice[room]]] += 1
            room -= sizes[choice[room]]
    return float(best[capacity]), pattern


def solve_patterns(lengths: np.ndarray, demand: np.ndarray, capacity: int, pool: np.ndarray, gap: float = 0.001, pivots: int = 1500) -> list[tuple[np.ndarray, float]]:
    """Patterns and their fractional uses, covering ``demand`` with nearly the fewest sequences.

    Revised simplex, begun with each length by itself. Columns of ``pool`` (one pattern a column) enter
    while any of them improves; then the knapsack prices new ones. It stops at optimality, or when the
    tokens themselves or Farley's bound show the solution within ``gap``, or after ``pivots`` (any basis
    on the way is a complete packing, so results stay whole).
    """
    basis = np.diag((capacity // lengths).astype(float))
    inverse = np.diag(1.0 / np.diag(basis))
    uses = inverse @ demand
    lower = float(lengths @ demand) / capacity
    for step in range(pivots):
        objective = uses.sum()
        if objective <= lower * (1 + gap) or objective - lower < 0.5:
            break
        duals = inverse.sum(axis=0)
        worth = duals @ pool
        if worth.size and worth.max() > 1 + 1e-9:
            pattern = pool[:, int(worth.argmax())]
        else:
            value, pattern = _knapsack(lengths, np.maximum(duals, 0), capacity)
            lower = max(lower, objective / max(value, 1.0))
            if value <= 1 + 1e-9:
                break
        direction = inverse @ pattern
        positive = direction > 1e-7
        if not positive.any():
            break
        ratios = np.where(positive, uses / np.where(positive, direction, 1), np.inf)
        theta = ratios.min()
        leave = int(np.where(ratios <= theta + 1e-9, direction, -1).argmax())  # of ties, the stablest pivot
        uses = np.maximum(uses - theta * direction, 0)
        uses[leave] = theta
        pivot_row = inverse[leave] / direction[leave]
        inverse -= np.outer(direction, pivot_row)
        inverse[leave] = pivot_row
        basis[:, leave] = pattern
        if step % 250 == 249:
            inverse = np.linalg.inv(basis)
            uses = np.maximum(inverse @ demand, 0)
    return [(basis[:, j], float(uses[j])) for j in range(len(lengths)) if uses[j] > 1e-9]


def _longest_first(lengths: np.ndarray, left: np.ndarray, capacity: int) -> dict[tuple, int]:
    """Pack what rounding left: a sequence takes the longest that still fit, and is repeated while the counts last."""
    packed: dict[tuple, int] = {}
    left = left.astype(np.int64).copy()
    order = np.argsort(-lengths)
    while left.any():
        room, items = capacity, []
        for i in order:
            take = int(min(left[i], room // lengths[i]))
            if take:
                items.append((int(i), take))
                left[i] -= take
                room -= take * int(lengths[i])
        # the same filling can be repeated while the counts last
        repeat = 1 + int(min(left[i] // take for i, take in items))
        for i, take in items:
            left[i] -= take * (repeat - 1)
        key = tuple(items)
        packed[key] = packed.get(key, 0) + repeat
    return packed


@dataclass
class Plan:
    """rows: (length, first_rank, last_rank, copies, first_sequence, base). Rank k (from 0) of a length
    with first_rank <= k <= last_rank is item (k - first_rank) % copies of sequence
    first_sequence + (k - first_rank) // copies, at base + length * item.

    fillers: (length, first_rank, stream_start): ranks from first_rank on lie end to end in the filler
    stream. gaps: (stream_start, size, first_sequence, times): consecutive parts of that stream, each
    ``size`` long, fill the ends of ``times`` consecutive sequences.
    """

    rows: list[tuple]
    fillers: list[tuple]
    gaps: list[tuple]


def _choose_fillers(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> np.ndarray:
    """How many of each length to cut up: about as many tokens as uncut packing would waste, longest first."""
    tokens = int((lengths * counts).sum())
    waste = capacity * sum(_longest_first(lengths, counts, capacity).values()) - tokens
    wanted = math.ceil(tokens * waste / (tokens + waste)) if waste else 0
    chosen = np.zeros_like(counts)
    for i in np.argsort(-lengths):
        chosen[i] = min(counts[i], math.ceil(wanted / lengths[i]))
        wanted -= int(chosen[i] * lengths[i])
        if wanted <= 0:
            break
    return chosen


def _rounded(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> dict[tuple, int]:
    """Whole uses of patterns: the linear program's, rounded down, and longest-first for what is left.

    Longest-first patterns also seed the program; where they alone need fewer sequences than the rounded program
    (which can be, as rounding loses up to a sequence a pattern), they are the answer.
    """
    simple = _longest_first(lengths, counts, capacity)
    pool = np.zeros((len(lengths), len(simple)))
    for j, key in enumerate(simple):
        for i, n in key:
            pool[i, j] = n
    left, whole = counts.copy(), {}
    solved = solve_patterns(lengths, counts.astype(float), capacity, pool, pivots=int(min(1500, 2 * counts.sum())))
    for pattern, used in sorted(solved, key=lambda p: -p[1]):
        times_each = np.rint(pattern).astype(np.int64)
        held = times_each > 0
        times = int(min(np.floor(used + 1e-6), (left[held] // times_each[held]).min()))
        if times > 0:
            key = tuple((int(i), int(times_each[i])) for i in np.flatnonzero(held))
            whole[key] = whole.get(key, 0) + times
            left -= times_each * times
    for key, times in _longest_first(lengths, left, capacity).items():
        whole[key] = whole.get(key, 0) + times
    return whole if sum(whole.values()) <= sum(simple.values()) else simple


def plan_patterns(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Place every rank of every length."""
    if not histogram:
        return Plan([], [], [])
    all_lengths = np.array(sorted(histogram), np.int64)
    counts = np.array([histogram[int(x)] for x in all_lengths], np.int64)
    chosen = _choose_fillers(all_lengths, counts, capacity)
    kept = counts - chosen
    lengths, left = all_lengths[kept > 0], kept[kept > 0].copy()
    whole = _rounded(lengths, left, capacity) if len(lengths) else {}
    rows, gaps, sequence, stream = [], [], 0, 0
    next_rank = [0] * len(lengths)
    # the smallest gaps come first, so that a stream that ends early leaves few of them open
    fill = {key: sum(int(lengths[i]) * c for i, c in key) for key in whole}
    for key in sorted(whole, key=lambda k: (-fill[k], k)):
        times, base = whole[key], 0
        for i, copies in key:
            size, first = int(lengths[i]), next_rank[i]
            rows.append((size, first, first + copies * times - 1, copies, sequence, base))
            next_rank[i] = first + copies * times
            base += size * copies
        if base < capacity:
            gaps.append((stream, capacity - base, sequence, times))
            stream += (capacity - base) * times
        sequence += times
    fillers, start = [], 0
    for size, n_kept, n in zip(all_lengths, kept, chosen):
        if n:
            fillers.append((int(size), int(n_kept), start))
            start += int(size * n)
    gaps.append((stream, capacity, sequence, max(0, -(-(start - stream) // capacity)) + 1))
    return Plan(rows, fillers, gaps)


def _cut(path: str, capacity: int, eos: int):
    end = np.array([eos], "<u4").tobytes()

    def run(batches):
        part = TaskContext.get().partitionId()
        encode = bpe.encoder(path).encode
        ordinals: dict[int, int] = {}
        for batch in batches:
            out = []
            for i, text in zip(batch["id"], batch["text"]):
                ids = encode(text) + end
                n = len(ids) // 4
                for start in range(0, n, capacity):
                    raw = ids[4 * start : 4 * (start + capacity)]
                    size = len(raw) // 4
                    ordinal = ordinals.get(size, 0)
                    ordinals[size] = ordinal + 1
                    out.append((i, start, size, zlib.crc32(raw), raw, n, part, ordinal))
            yield pd.DataFrame(out, columns=["id", "start", "length", "ids_crc32", "ids", "doc_tokens", "part", "ordinal"])
        tidy()

    return run


def _fill(gaps: list[tuple], capacity: int):
    """Cut filler rests at the ends of the gaps that their place in the stream meets."""
    starts, sizes, sequences, _ = (np.array(x, np.int64) for x in zip(*gaps))

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                at, stop = row.stream, row.stream + row.length
                while at < stop:
                    g = int(np.searchsorted(starts, at, side="right")) - 1
                    k, inside = divmod(at - starts[g], sizes[g])
                    size = int(min(sizes[g] - inside, stop - at))
                    skip = at - row.stream
                    raw = row.ids[4 * skip : 4 * (skip + size)]
                    out.append((row.id, row.start + skip, size, zlib.crc32(raw), raw, row.doc_tokens, sequences[g] + k, capacity - sizes[g] + inside))
                    at += size
            yield pd.DataFrame(out, columns=["id", "start", "length", "ids_crc32", "ids", "doc_tokens", "sequence_id", "offset"])

    return run


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, capacity: int = CAPACITY, eos: int = EOS_ID) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, ids, doc_tokens, sequence_id, offset.

    ids: the piece's ids as little-endian 32-bit integers; a reader that leaves the column out has it
    pruned from the scan. A null or empty text is the end id alone. Equal texts are packed as often as
    they occur. A very long text is cut into full sequences and a rest; rests of equal length take ranks by task and
    order. An empty table gives no rows. Columns other than the two named are not looked at. Null ids are kept as
    null. Full pieces have sequences from 2**40 on, by task; mixed ones count from 0.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    pieces = scratch.store(narrow.mapInPandas(_cut(tokenizer_path or bpe.vocabulary_path(), capacity, eos), PIECES), "pieces")
    rests = pieces.filter(F.col("length") < capacity)
    by_part = rests.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = plan_patterns(histogram, capacity)
    rows = F.broadcast(spark.createDataFrame(plan.rows, PLAN))
    fillers = F.broadcast(spark.createDataFrame(plan.fillers, "length int, first_filler long, stream_start long"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ranks_before"))
    columns = ["id", "start", "length", "ids_crc32", "ids", "doc_tokens"]
    # only ids that a result needs travel: rows are placed by where they are, and joined to their pieces by task
    ranked = rests.join(offsets, ["part", "length"]).withColumn("rank", F.col("ranks_before") + F.col("ordinal"))
    placed = ranked.join(rows, (F.col("length") == F.col("plan_length")) & F.col("rank").between(F.col("first_rank"), F.col("last_rank")))
    in_run = F.col("rank") - F.col("first_rank")
    mixed = placed.select(
        *columns,
        (F.col("first_sequence") + F.floor(in_run / F.col("copies"))).cast("long").alias("sequence_id"),
        (F.col("base") + (in_run % F.col("copies")) * F.col("length")).cast("long").alias("offset"),
    )
    full = pieces.filter(F.col("length") == capacity).select(
        *columns, (F.shiftleft(F.col("part").cast("long") + 1, 40) + F.col("ordinal")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    out = mixed.unionByName(full)
    if plan.fillers:
        to_cut = ranked.join(fillers, "length").filter(F.col("rank") >= F.col("first_filler"))
        stream = F.col("stream_start") + (F.col("rank") - F.col("first_filler")) * F.col("length")
        out = out.unionByName(to_cut.select(*columns, stream.alias("stream")).mapInPandas(_fill(plan.gaps, capacity), PLACED))
    return out


def query(spark, sf_dir: str) -> DataFrame:
    packed = pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return packed.select(F.col("id").alias("doc_id"), "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens", "sequence_id", "offset")
