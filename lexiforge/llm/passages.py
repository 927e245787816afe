"""Removal of repeated byte strings: every byte covered by a string of ``SIZE`` bytes that starts elsewhere too.

Shards are made by content. In each string of SIZE bytes one gram of GRAM bytes is the anchor: the one with
the least hash. Equal strings have equal anchors at equal places, wherever they occur, so all strings with
one anchor gram can be judged together:

1. Shards of documents send the grams that are anchors, under two hash functions, each with a digest of the
   stretch of text whose strings it anchors. Buckets answer which grams and which stretches occur twice.
   Strings whose anchors occur once are unique. Stretches that occur twice as a whole are copies: they are
   counted here, by gram and digest, before anything is sorted.
2. What remains - stretches whose anchor occurs elsewhere in other surroundings - goes to shards by anchor. Each shard
   sorts its stretches into a suffix array, takes common prefixes, and finds the repeated strings; parts of a large
   shard are merged by binary search. An anchor with very many surroundings - in a line of almost SIZE bytes that
   thousands of texts share, say - would fill a shard by itself: of its stretches only digests of whole strings
   travel, to buckets by digest, each once for a shard of documents. No key holds more than one row for such a shard.
3. The answers go back to the documents that wait for them.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import Scratch, mix64, tidy
from .suffixes import repeated_starts

SIZE = 200
GRAM = 64
WINDOW = SIZE - GRAM + 1
#: Surroundings that make an anchor hot.
HOT_ANCHOR = 1024
#: Shuffled bytes of a task.
TASK_BYTES = 32 << 20
#: Text of a shard of documents; of a shard of stretches, and of one suffix array in it; anchors of a bucket.
SHARD_BYTES = 4 << 20
SHARD_DOCS = 50_000
STRETCH_SHARD_BYTES = 1 << 20
ARRAY_BYTES = 1 << 20
BUCKET_ANCHORS = 1 << 18
#: Text that is hashed at a time; a longer one is read in overlapping pieces.
PIECE_BYTES = 1 << 18

_rng = np.random.default_rng(20240307)
_BYTES = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SECOND = np.uint64(0xD1B54A32D192ED03)
_MASK40 = np.uint64((1 << 40) - 1)
_tables: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables.get("up", ())) < n:
        with np.errstate(over="ignore"):
            for name, step in (("up", _STEP), ("down", _BACK)):
                table = np.full(n, step)
                table[0] = 1
                _tables[name] = np.cumprod(table)
    return _tables["up"][:n], _tables["down"][:n]


class Hashes:
    """Hashes of all substrings of a block by sums of powers."""

    def __init__(self, text: np.ndarray):
        up, self.down = _powers(len(text) + 1)
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTES[text] * up[:-1])])

    def of(self, starts, ends) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64((self.sums[ends] - self.sums[starts]) * self.down[starts] + (np.asarray(ends) - starts).astype(np.uint64))


def _window_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, by running minima from both ends of blocks of that width."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


class Anchored:
    """Pieces of texts, hashed as one block: the strings of SIZE bytes that lie within a piece, in runs.

    pieces: (text number, offset in the text, bytes). A run is a stretch of neighbouring strings with one
    anchor. Only what is kept per run outlives the construction.
    """

    def __init__(self, pieces: list[tuple[int, int, bytes]]):
        self.text = np.frombuffer(b"".join(p for _, _, p in pieces), np.uint8)
        self.number = np.array([k for k, _, _ in pieces], np.int64)
        lengths = np.array([len(p) for _, _, p in pieces], np.int64)
        self.piece_starts = np.cumsum(lengths) - lengths
        self.shift = np.array([o for _, o, _ in pieces], np.int64) - self.piece_starts  # from block to text offsets
        counts = np.maximum(lengths - SIZE + 1, 0)
        self.any = bool(counts.sum())
        if not self.any:
            return
        n = len(self.text)
        hashes = Hashes(self.text)
        grams = hashes.of(np.arange(n - GRAM + 1), np.arange(GRAM, n + 1))
        starts = np.arange(int(counts.sum())) + np.repeat(self.piece_starts - (np.cumsum(counts) - counts), counts)
        for kind, ranks in (("first", grams), ("second", mix64(grams ^ _SECOND))):
            anchor = _anchors(ranks, starts)
            cuts = np.flatnonzero((np.diff(anchor) != 0) | (np.diff(starts) != 1)) + 1
            head = np.concatenate([[0], cuts])
            # the grams of anchors are least ones: mixed again, their leading bits spread over all buckets
            runs = {"begin": starts[head], "end": starts[np.concatenate([cuts, [len(starts)]]) - 1] + 1, "gram": mix64(grams[anchor[head]]), "anchor": anchor[head]}
            setattr(self, kind, runs)
        runs = self.first
        # the place of the anchor in the stretch belongs to its identity
        with np.errstate(over="ignore"):
            runs["digest"] = hashes.of(runs["begin"], runs["end"] - 1 + SIZE) ^ ((runs["anchor"] - runs["begin"]).astype(np.uint64) * _STEP)

    def piece_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.piece_starts, places, side="right") - 1


def _anchors(ranks: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The place of the least gram of each string; the first of equals."""
    place_bits = np.uint64(max(int(len(ranks)).bit_length(), 24))
    low = (np.uint64(1) << place_bits) - np.uint64(1)
    keyed = (ranks & ~low) | np.arange(len(ranks), dtype=np.uint64)
    return (_window_minimum(keyed, WINDOW)[starts] & low).astype(np.int64)


def _blocks(texts: list[bytes]):
    """Blocks of about PIECE_BYTES; pieces of a long text overlap, so each string of SIZE bytes is in one."""
    part, held = [], 0
    for k, t in enumerate(texts):
        for offset in range(0, max(len(t) - SIZE + 1, 1), PIECE_BYTES):
            piece = t[offset : offset + PIECE_BYTES + SIZE - 1]
            if part and held + len(piece) > PIECE_BYTES:
                yield Anchored(part)
                part, held = [], 0
            part.append((k, offset, piece))
            held += len(piece)
    if part:
        yield Anchored(part)


def _raw(text) -> bytes:
    if text is None:
        return b""
    return text if isinstance(text, bytes) else text.encode("utf-8", "surrogatepass")


def _sharded(batches, text_col: str):
    """(shard key, rows so far in it, batch part): shards of bounded size, made alike in each pass."""
    part, count, held, rows = TaskContext.get().partitionId(), 0, 0, 0
    for batch in batches:
        sizes = [len(_raw(t)) for t in batch.column(text_col).to_pylist()]
        first = 0
        for i, size in enumerate(sizes):
            if rows and (held + size > SHARD_BYTES or rows >= SHARD_DOCS):
                if i > first:
                    yield (part << 24) + count, rows - (i - first), batch.slice(first, i - first)
                count, held, rows, first = count + 1, 0, 0, i
            held += size
            rows += 1
        if len(sizes) > first:
            yield (part << 24) + count, rows - (len(sizes) - first), batch.slice(first)


_MOVED = "bucket int, shard long, n int, payload binary"


def _distinct_anchors(blocks: list[Anchored]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What a shard asks: distinct (gram, digest) of its stretches and whether it has them twice; distinct second
    grams and whether they are at two places."""
    grams = np.concatenate([b.first["gram"] for b in blocks])
    digests = np.concatenate([b.first["digest"] for b in blocks])
    order = np.lexsort((digests, grams))
    grams, digests = grams[order], digests[order]
    new = np.flatnonzero(np.concatenate([[True], (grams[1:] != grams[:-1]) | (digests[1:] != digests[:-1])]))
    twice = np.diff(np.append(new, len(grams))) > 1
    places = [np.unique(b.second["anchor"], return_index=True)[1] for b in blocks]
    second, counts = np.unique(np.concatenate([b.second["gram"][p] for b, p in zip(blocks, places)]), return_counts=True)
    return np.stack([grams[new], digests[new]]), twice, second, counts > 1


def _ask(bits: int, text_col: str):
    def flush(shard, texts):
        check = zlib.crc32(b"".join(hashlib.blake2b(t, digest_size=8).digest() for t in texts))
        rows = [(-1, shard, len(texts), check.to_bytes(4, "little"))]
        blocks = [b for b in _blocks(texts) if b.any]
        if blocks:
            first, first_twice, second, second_twice = _distinct_anchors(blocks)
            for kind, grams, twice in ((0, first[0], first_twice), (1, second, second_twice)):
                bucket = (grams >> np.uint64(64 - bits)).astype(np.int64)
                cuts = np.flatnonzero(np.diff(bucket)) + 1
                for lo, hi in zip([0, *cuts], [*cuts, len(grams)]):
                    payload = grams[lo:hi].tobytes() + (first[1][lo:hi].tobytes() if kind == 0 else b"") + twice[lo:hi].tobytes()
                    rows.append((int(bucket[lo]) * 2 + kind, shard, int(hi - lo), payload))
        return pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["bucket", "shard", "n", "payload"]), schema=_ASK_SCHEMA, preserve_index=False)

    def run(batches):
        current, texts = None, []
        for shard, _, part in _sharded(batches, text_col):
            if shard != current and texts:
                yield flush(current, texts)
                texts = []
                tidy()
            current = shard
            texts += map(_raw, part.column(text_col).to_pylist())
        if texts:
            yield flush(current, texts)

    return run


_ASK_SCHEMA = pa.schema([("bucket", pa.int32()), ("shard", pa.int64()), ("n", pa.int32()), ("payload", pa.binary())])
REPEATED, ELSEWHERE, HOT = 1, 2, 4


def _answer(hot_anchor: int):
    """For each asked gram: is the stretch (kind 1: the gram) repeated; is the gram in other stretches too, or in
    very many of them."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        bucket = key[0]
        if bucket < 0:
            return rows
        counts = rows["n"].to_numpy()
        grams = np.concatenate([np.frombuffer(p, np.uint64, n) for p, n in zip(rows["payload"], counts)])
        first = bucket % 2 == 0
        digests = np.concatenate([np.frombuffer(p, np.uint64, n, 8 * n) for p, n in zip(rows["payload"], counts)]) if first else np.zeros(len(grams), np.uint64)
        twice = np.concatenate([np.frombuffer(p, bool, n, (16 if first else 8) * n) for p, n in zip(rows["payload"], counts)])
        order = np.lexsort((digests, grams))
        g, d = grams[order], digests[order]
        new_gram = np.concatenate([[True], g[1:] != g[:-1]])
        new_pair = new_gram | np.concatenate([[True], d[1:] != d[:-1]])
        pair, gram = np.cumsum(new_pair) - 1, np.cumsum(new_gram) - 1
        repeated = (np.bincount(pair, weights=1 + twice[order]) > 1)[pair]
        surroundings = np.bincount(gram[new_pair])[gram]
        elsewhere, hot = surroundings > 1, surroundings >= hot_anchor
        status = np.zeros(len(grams), np.uint8)
        status[order] = REPEATED * repeated + ELSEWHERE * elsewhere + HOT * hot
        ends = np.cumsum(counts)
        return pd.DataFrame({"bucket": bucket, "shard": rows["shard"].to_numpy(), "n": counts, "payload": [status[e - n : e].tobytes() for e, n in zip(ends, counts)]})

    return run


def _merge_spans(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Union of intervals as rows (start, end); touching ones are one."""
    if not len(starts):
        return np.zeros((0, 2), np.int64)
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    first = np.concatenate([[True], starts[1:] > ends[:-1]])
    return np.stack([starts[first], ends[np.append(np.flatnonzero(first)[1:] - 1, len(ends) - 1)]], axis=1)


def _finish(raw: bytes, spans: np.ndarray, with_text: bool) -> tuple:
    pieces, at = [], 0
    for a, b in spans:
        pieces.append(raw[at:a])
        at = b
    kept = b"".join([*pieces, raw[at:]])
    return len(raw), int((spans[:, 1] - spans[:, 0]).sum()), len(spans), hashlib.sha256(kept).hexdigest(), kept if with_text else None, spans.astype("<i8").tobytes() if with_text else None


_RESULT = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"]
_RESULT_DDL = "n_bytes long, n_removed long, n_spans int, kept_sha256 string, kept binary, spans binary"
_RESULT_ARROW = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.binary(), pa.binary()]
_WAIT_DDL = "shard_ long, row_ int, raw_ binary, settled_ binary, waits_ binary, hot_ binary, gram_ long, stretch_ int, stretch_text_ binary"
_WAIT = ["shard_", "row_", "raw_", "settled_", "waits_", "hot_", "gram_", "stretch_", "stretch_text_"]
_WAIT_ARROW = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.binary()]


def _string_digests(hashes: Hashes, starts: np.ndarray) -> np.ndarray:
    """Two hashes of each string of SIZE bytes, one of either half, as rows."""
    half = SIZE // 2
    return np.stack([hashes.of(starts, starts + half), hashes.of(starts + half, starts + SIZE)], axis=1)


def _distinct_pairs(pairs: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows, the sum of their times, and the number of its distinct row for each row."""
    order = np.lexsort((pairs[:, 1], pairs[:, 0]))
    ordered = pairs[order]
    new = np.concatenate([[True], (ordered[1:] != ordered[:-1]).any(axis=1)])
    of = np.zeros(len(pairs), np.int64)
    of[order] = np.cumsum(new) - 1
    return ordered[new], np.bincount(of, weights=times).astype(np.int64), of


#: The number of a row that carries digests of strings instead of a stretch.
_DIGESTS = -2


def _digest_rows(shard: int, pairs: list[np.ndarray], bits: int) -> list[tuple]:
    """What a shard asks about strings with hot anchors: rows for buckets, each distinct digest once."""
    distinct, times, _ = _distinct_pairs(np.concatenate(pairs), np.ones(sum(map(len, pairs)), np.int64))
    bucket = (mix64(distinct[:, 0] ^ mix64(distinct[:, 1] ^ _SECOND)) >> np.uint64(64 - bits)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    distinct, times, bucket = distinct[order], times[order], bucket[order]
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    return [(shard, int(bucket[lo]), distinct[lo:hi].tobytes() + (times[lo:hi] > 1).tobytes()) for lo, hi in zip([0, *cuts], [*cuts, len(bucket)])]


def _match(rows: pd.DataFrame) -> pd.DataFrame:
    """To each shard, which of its digests occur at several places."""
    counts = np.array([len(p) // 17 for p in rows["stretch_text_"]], np.int64)
    pairs = np.concatenate([np.frombuffer(p, np.uint64, 2 * n).reshape(-1, 2) for p, n in zip(rows["stretch_text_"], counts)])
    twice = np.concatenate([np.frombuffer(p, bool, n, 16 * n) for p, n in zip(rows["stretch_text_"], counts)])
    _, times, of = _distinct_pairs(pairs, 1 + twice)
    repeated = times[of] > 1
    ends = np.cumsum(counts)
    out = [(shard, _DIGESTS, pairs[e - n : e][repeated[e - n : e]].tobytes()) for shard, n, e in zip(rows["shard_"], counts, ends) if repeated[e - n : e].any()]
    return pd.DataFrame(out, columns=["shard_", "stretch_", "spans_"])


def _repeated_strings(raw: bytes, intervals: np.ndarray, repeated: np.ndarray) -> np.ndarray:
    """Spans of the strings that start in the intervals and have one of the repeated digests (as 16 bytes each, sorted)."""
    found = [np.zeros((0, 2), np.int64)]
    for low, high in intervals if len(repeated) else ():
        starts = np.arange(high - low)
        digests = _string_digests(Hashes(np.frombuffer(raw, np.uint8)[low : high - 1 + SIZE]), starts).view("V16").ravel()
        at = np.minimum(np.searchsorted(repeated, digests), len(repeated) - 1)
        starts = low + starts[repeated[at] == digests]
        found.append(_merge_spans(starts, starts + SIZE))
    return np.concatenate(found)


def _settle(carried: list[str], text_col: str, with_text: bool, bits: int):
    """A shard with its answers: finished documents, waiting ones, and the stretches and digests they wait for."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        schema = pa.schema([*(docs.schema.field(c) for c in carried), *zip(_RESULT, _RESULT_ARROW), *zip(_WAIT, _WAIT_ARROW)])
        if docs.num_rows == 0:
            return schema.empty_table()
        docs = docs.sort_by("row_")
        shard = docs.column("shard_")[0].as_py()
        texts = [_raw(t) for t in docs.column(text_col).to_pylist()]
        replies = answers.to_pandas().sort_values("bucket", kind="stable")
        head = replies[replies["bucket"] < 0]
        check = zlib.crc32(b"".join(hashlib.blake2b(t, digest_size=8).digest() for t in texts))
        if len(head) != 1 or head.iloc[0]["payload"] != check.to_bytes(4, "little"):
            raise ValueError("the documents changed between two reads: store them first")
        results: list = [None] * len(texts)
        waiting: dict[int, tuple] = {}
        stretches: list[tuple] = []
        blocks = [b for b in _blocks(texts) if b.any]
        spans_of: dict[int, list] = {}
        waits_of: dict[int, list] = {}
        hot_of: dict[int, list] = {}  # intervals of starts, by document
        hot_pairs: list[np.ndarray] = []
        if blocks:
            (grams, digests), _, second, _ = _distinct_anchors(blocks)
            kinds = replies["bucket"] % 2
            status = np.frombuffer(b"".join(replies[(replies["bucket"] >= 0) & (kinds == 0)]["payload"]), np.uint8)
            second_status = np.frombuffer(b"".join(replies[(replies["bucket"] >= 0) & (kinds == 1)]["payload"]), np.uint8)
            pairs = np.rec.fromarrays([grams, digests])
            sent_targets: set = set()
        for b in blocks:
            runs = b.first
            at = np.searchsorted(grams, runs["gram"])
            if (grams[np.minimum(at + 1, len(grams) - 1)] == runs["gram"]).any():  # a gram with several stretches
                at = np.searchsorted(pairs, np.rec.fromarrays([runs["gram"], runs["digest"]]))
            state = status[at]
            piece = b.piece_of(runs["begin"])
            for k in np.flatnonzero(state & REPEATED):
                shift = b.shift[piece[k]]
                spans_of.setdefault(int(b.number[piece[k]]), []).append((runs["begin"][k] + shift, runs["end"][k] - 1 + SIZE + shift))
            wanted = np.flatnonzero(state & ELSEWHERE)
            if not len(wanted):
                continue
            likely = np.zeros(len(b.text) + 1, np.int64)  # strings whose second anchor is elsewhere too, as running counts
            held = second_status[np.searchsorted(second, b.second["gram"])] > 0
            np.add.at(likely, b.second["begin"][held], 1)
            np.add.at(likely, b.second["end"][held], -1)
            likely = np.cumsum(likely) > 0
            hot_starts: list[np.ndarray] = []
            for k in wanted:
                lo, hi = int(runs["begin"][k]), int(runs["end"][k])
                settled = bool(state[k] & REPEATED)
                if settled:  # but others are compared with it: once is enough
                    name = (int(runs["gram"][k]), int(runs["digest"][k]))
                    if name in sent_targets:
                        continue
                    sent_targets.add(name)
                if state[k] & HOT:
                    starts = lo + (np.arange(hi - lo) if settled else np.flatnonzero(likely[lo:hi]))
                    if len(starts):
                        hot_starts.append(starts)
                        if not settled:
                            shift = int(b.shift[piece[k]])
                            hot_of.setdefault(int(b.number[piece[k]]), []).append((int(starts[0]) + shift, int(starts[-1]) + 1 + shift))
                    continue
                number = -1
                if not settled:
                    inside = np.flatnonzero(likely[lo:hi])
                    if not len(inside):
                        continue
                    lo, hi = lo + int(inside[0]), lo + int(inside[-1]) + 1
                    number = len(stretches)
                    waits_of.setdefault(int(b.number[piece[k]]), []).append((number, lo + int(b.shift[piece[k]])))
                stretches.append((int(runs["gram"][k].astype(np.int64)), number, b.text[lo : hi - 1 + SIZE].tobytes()))
            if hot_starts:
                hot_pairs.append(_string_digests(Hashes(b.text), np.concatenate(hot_starts)))
        for k, text in enumerate(texts):
            own = np.array(spans_of.get(k, np.zeros((0, 2))), np.int64).reshape(-1, 2)
            spans = _merge_spans(own[:, 0], own[:, 1])
            if k in waits_of or k in hot_of:
                waiting[k] = (spans, np.array(waits_of.get(k, []), np.int64), np.array(hot_of.get(k, []), np.int64))
            else:
                results[k] = _finish(text, spans, with_text)
        blank = (None,) * len(_RESULT)
        found = [r or blank for r in results]
        waits = [(shard, i, texts[i], *(x.tobytes() for x in waiting[i]), None, None, None) if i in waiting else (None,) * len(_WAIT) for i in range(len(texts))]
        columns = [docs.column(c).combine_chunks() for c in carried]
        columns += [pa.array([f[k] for f in found], kind) for k, kind in enumerate(_RESULT_ARROW)]
        columns += [pa.array([w[k] for w in waits], kind) for k, kind in enumerate(_WAIT_ARROW)]
        rows = pa.Table.from_arrays(columns, schema=schema)
        asked = [(shard, None, None, None, None, None, g, number, text) for g, number, text in stretches]
        if hot_pairs:
            asked += [(shard, None, None, None, None, None, bucket, _DIGESTS, payload) for shard, bucket, payload in _digest_rows(shard, hot_pairs, bits)]
        empty = [pa.nulls(len(asked), f.type) for f in list(schema)[: len(carried) + len(_RESULT)]]
        more = pa.Table.from_arrays([*empty, *(pa.array([a[k] for a in asked], kind) for k, kind in enumerate(_WAIT_ARROW))], schema=schema)
        del blocks, texts, stretches, hot_pairs, asked, results, found, waits
        tidy()
        return pa.concat_tables([rows, more])

    return run


def _judge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """The repeated starts of the stretches of a content shard, or the repeated digests of a bucket, for those who wait."""
    if key[0] < 0:
        return _match(rows)
    texts, which, times = np.unique(np.array(rows["stretch_text_"], object), return_inverse=True, return_counts=True)
    flags = repeated_starts(list(texts), SIZE, ARRAY_BYTES)
    for k in np.flatnonzero(times > 1):  # stretches of several places, cut to the same text: all its strings are repeated
        flags[k][: len(texts[k]) - SIZE + 1] = True
    out = []
    for shard, number, k in zip(rows["shard_"], rows["stretch_"], which):
        if number >= 0 and flags[k].any():
            at = np.flatnonzero(flags[k])
            out.append((shard, number, _merge_spans(at, at + SIZE).tobytes()))
    del texts, flags
    tidy()
    return pd.DataFrame(out, columns=["shard_", "stretch_", "spans_"])


def _complete(carried: list[str], with_text: bool):
    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        given = list(zip(replies.column("stretch_").to_pylist(), replies.column("spans_").to_pylist()))
        answers = {n: np.frombuffer(s, np.int64).reshape(-1, 2) for n, s in given if n >= 0}
        repeated = np.sort(np.frombuffer(b"".join(s for n, s in given if n == _DIGESTS), "V16"))
        found = []
        for raw, settled, waits, hot in zip(*(docs.column(c).to_pylist() for c in ("raw_", "settled_", "waits_", "hot_"))):
            spans = [np.frombuffer(settled, np.int64).reshape(-1, 2)]
            for number, start in np.frombuffer(waits, np.int64).reshape(-1, 2):
                if int(number) in answers:
                    spans.append(answers[int(number)] + start)
            spans.append(_repeated_strings(raw, np.frombuffer(hot, np.int64).reshape(-1, 2), repeated))
            spans = np.concatenate(spans)
            found.append(_finish(raw, _merge_spans(spans[:, 0], spans[:, 1]), with_text))
        columns = [docs.column(c).combine_chunks() for c in carried] + [pa.array([f[k] for f in found], kind) for k, kind in enumerate(_RESULT_ARROW)]
        return pa.Table.from_arrays(columns, schema=pa.schema([*(docs.schema.field(c) for c in carried), *zip(_RESULT, _RESULT_ARROW)]))

    return run


def remove_repeats(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, with_text: bool = True) -> DataFrame:
    """One row per row of docs: the columns ``keep`` (default: all but the text), n_bytes, n_removed, n_spans,
    kept_sha256, and with ``with_text`` kept (the bytes that remain) and spans (removed runs, as pairs of
    little-endian 64-bit offsets).

    A byte goes if a string of 200 bytes covers it that starts anywhere else, in the same document or another;
    strings do not reach over documents, and are judged on the input. So all copies of a passage go. Null
    texts are empty; texts under 200 bytes keep everything; repeated rows are copies; an empty table gives no
    rows. Kept columns may have any names but those of the results or names that end in an underscore. docs
    must read alike twice (a stored table); a change between the reads is noticed and raises an error. Texts of
    any length are read whole, in overlapping pieces. Of several least grams of a string the first is the anchor.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "passages")
    carried = [c for c in docs.columns if c != text_col] if keep is None else list(keep)
    if clash := {c for c in carried if c in _RESULT or c in _WAIT}:
        raise ValueError(f"columns with names of results: {sorted(clash)}")
    total = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    bits = min(24, max(6, (total * 2 // WINDOW // BUCKET_ANCHORS).bit_length()))
    narrow = docs.select(text_col)
    # partitions follow the input, whatever the session's default is: no task reads more as the table grows
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_BYTES))
    answers = narrow.mapInArrow(_ask(bits, text_col), _MOVED).repartition(tasks, "bucket").groupBy("bucket").applyInPandas(_answer(HOT_ANCHOR), _MOVED)

    def number(batches):
        for shard, first, part in _sharded(batches, text_col):
            arrays = [part.column(c) for c in [*carried, text_col]]
            arrays += [pa.array([shard] * part.num_rows, pa.int64()), pa.array(range(first, first + part.num_rows), pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*carried, text_col, "shard_", "row_"])

    chosen = docs.select(*carried, text_col)
    numbered = chosen.mapInArrow(number, StructType([*chosen.schema, *StructType().add("shard_", "long").add("row_", "integer")]))
    own = chosen.select(*carried).schema
    result = StructType([*own, *StructType.fromDDL(_RESULT_DDL)])
    settled = StructType([*result, *StructType.fromDDL(_WAIT_DDL)])
    replies = answers.withColumnRenamed("shard", "shard_").repartition(tasks, "shard_")
    rows = numbered.repartition(tasks, "shard_").groupBy("shard_").cogroup(replies.groupBy("shard_"))
    stored = scratch.store(
        rows.applyInArrow(_settle(carried, text_col, with_text, bits), settled),
        "settled",
        F.sum(F.octet_length("stretch_text_")).alias("stretch_bytes"),
        F.count("raw_").alias("waiting"),
    )
    finished = stored.filter("n_bytes IS NOT NULL").select(*carried, *_RESULT)
    if not stored.seen["waiting"]:
        return finished
    shards = max(1, -(-(stored.seen["stretch_bytes"] or 0) // STRETCH_SHARD_BYTES))
    place = F.pmod("gram_", F.lit(shards)).cast("int")
    stretches = stored.filter("stretch_ IS NOT NULL").select(F.when(F.col("stretch_") == _DIGESTS, -1 - place).otherwise(place).alias("place"), "shard_", "stretch_", "stretch_text_")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(stored.seen["stretch_bytes"] or 0) // TASK_BYTES))
    replies = stretches.repartition(parts, "place").groupBy("place").applyInPandas(_judge, "shard_ long, stretch_ int, spans_ binary")
    waiting = stored.filter("raw_ IS NOT NULL").select(*carried, "shard_", "raw_", "settled_", "waits_", "hot_")
    completed = waiting.repartition(tasks, "shard_").groupBy("shard_").cogroup(replies.repartition(tasks, "shard_").groupBy("shard_")).applyInArrow(_complete(carried, with_text), result)
    return finished.unionByName(completed)


def query(spark, sf_dir: str) -> DataFrame:
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"], with_text=False)
    return found.select("doc_id", "n_bytes", "n_removed", F.col("n_spans").cast("long").alias("n_spans"), "kept_sha256")
