"""Periodic runs of words, by the algorithm of Kolpakov and Kucherov.

A run is a stretch of consecutive words with smallest period q, at least LEAST words and POWER periods long, that
no neighbouring word extends. The words of a text are numbered, and factorised in the manner of Lempel and Ziv by
a suffix automaton that knows where each of its strings ended first. A run that touches the start of a factor and
ends in it is found by Main's algorithm, from common prefixes and suffixes around that place. All other runs lie
strictly inside a factor, and are copied from where the factor occurred before.

Every string of NEEDED words of such a run occurs a second time in it, a period on. So only the stretches of a text
that repeated strings of that length cover are factorised; all others hold no word of a run.
"""

from __future__ import annotations

from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import mix64, ship_code, tidy

LEAST, POWER = 6, 4
#: With max(LEAST, POWER * q) words in a run, a string of so many words has a full period beside it, for any q.
NEEDED = 5
#: Bytes of results that are sent on together.
_FLUSH = 4 << 20


def factors(s: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, earlier start) of each factor: the longest string from there on that also starts earlier, or
    one new symbol (earlier start -1)."""
    follow: list[dict[int, int]] = [{}]
    link, length, ended = [-1], [0], [-1]
    last = 0
    for i, c in enumerate(s):
        new = len(follow)
        follow.append({})
        length.append(length[last] + 1)
        link.append(0)
        ended.append(i)
        p = last
        while p >= 0 and c not in follow[p]:
            follow[p][c] = new
            p = link[p]
        if p >= 0:
            q = follow[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:  # q's shorter strings end in more places: they get a state of their own
                split = len(follow)
                follow.append(dict(follow[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                ended.append(ended[q])
                while p >= 0 and follow[p].get(c) == q:
                    follow[p][c] = split
                    p = link[p]
                link[q] = link[new] = split
        last = new
    out, at, n = [], 0, len(s)
    while at < n:
        state, size = 0, 0
        while at + size < n:
            then = follow[state][s[at + size]]
            if ended[then] >= at + size:
                break
            state, size = then, size + 1
        out.append((at, max(size, 1), ended[state] - size + 1 if size else -1))
        at += max(size, 1)
    return out


def _prefixes(pattern: list[int], text: list[int] | None, most: int) -> list[int]:
    """For each place k of text, up to ``most`` places: how much of pattern's start is there. Without a text, for
    the places of pattern itself, from 1 on (place 0 gets its whole length)."""
    own = text is None
    text = pattern if own else text
    n, m = len(pattern), len(text)
    inner = None if own else _prefixes(pattern, None, n)
    out = [n] if own else []
    left = right = 0
    for k in range(1 if own else 0, min(most, m)):
        known = (out if own else inner)
        size = min(right - k, known[k - left]) if k < right else 0
        if k + size >= right:  # nothing is known beyond
            while size < n and k + size < m and pattern[size] == text[k + size]:
                size += 1
            left, right = k, k + size
        out.append(size)
    return out


def _touching(s: list[int], low: int, at: int, high: int):
    """(start, end, period) of repetitions within s[low:high] that touch the place ``at``, long enough for a run."""
    before, after = s[low:at][::-1], s[at:high]
    most = (high - low) // POWER
    # a period that lies behind the place: s[at:] against s[at + p:], and backwards s[:at] against s[:at + p]
    places = min(most, len(after))
    if places:
        ahead = _prefixes(after, None, places + 1)
        ahead += [0] * (places + 1 - len(ahead))
        around = after[:places][::-1] + before
        back = _prefixes(before, around, places) if before else [0] * places
        for p in range(1, places + 1):
            if (size := back[places - p] + p + ahead[p]) >= POWER * p and size >= LEAST:
                yield at - back[places - p], at + p + ahead[p], p
    # a period that lies before it
    places = min(most, len(before))
    if places:
        back = _prefixes(before, None, places + 1)
        back += [0] * (places + 1 - len(back))
        around = before[:places][::-1] + after
        ahead = _prefixes(after, around, places) if after else [0] * places
        for p in range(1, places + 1):
            if (size := back[p] + p + ahead[places - p]) >= POWER * p and size >= LEAST:
                yield at - p - back[p], at + ahead[places - p], p


def runs_of(symbols: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start and period."""
    s = [*symbols, -1]  # a symbol of its own: what ends at the end touches a factor's start
    n = len(s)
    found: dict[tuple[int, int], int] = {}
    starts: list[int] = []
    ends: dict[int, list[tuple[int, int]]] = {}

    def add(start: int, end: int, period: int) -> None:
        if (start, end) not in found:
            found[start, end] = period
            if start not in ends:
                insort(starts, start)
            ends.setdefault(start, []).append((end, period))

    previous = 0
    for at, size, earlier in factors(s):
        # a run that starts further back has its second period in the previous factor, which would then be longer
        low, high = max(0, at - 2 * previous - size), at + size
        new: dict[tuple[int, int], int] = {}
        if high - low >= LEAST:
            for start, end, period in _touching(s, low, at, high):
                whole = (start == 0 or s[start - 1] != s[start - 1 + period]) and (end == n or s[end] != s[end - period])
                if whole and period < new.get((start, end), n):
                    new[start, end] = period
        for (start, end), period in new.items():
            add(start, end, period)
        if earlier >= 0:
            k = bisect_right(starts, earlier)
            while k < len(starts) and starts[k] < earlier + size:
                for end, period in list(ends[starts[k]]):
                    if end < earlier + size:
                        add(starts[k] + at - earlier, end + at - earlier, period)
                k += 1
        previous = size
    return sorted((start, end - start, period) for (start, end), period in found.items())


_PLACES = mix64(np.arange(1, NEEDED + 1, dtype=np.uint64)) | np.uint64(1)


def stretches(symbols: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the stretches that strings of NEEDED symbols cover that occur again, LEAST symbols and more.

    Strings are told apart by fingerprints: two that share one only make a stretch longer.
    """
    size = len(symbols) - NEEDED + 1
    if size < 2:
        return []
    with np.errstate(over="ignore"):
        prints = sum((mix64(symbols[j : size + j].astype(np.uint64)) * _PLACES[j] for j in range(1, NEEDED)), mix64(symbols[:size].astype(np.uint64)) * _PLACES[0])
    order = np.argsort(prints)
    same = prints[order[1:]] == prints[order[:-1]]
    if not same.any():
        return []
    again = np.zeros(size, bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    steps = np.zeros(len(symbols) + 1, np.int32)
    places = np.flatnonzero(again)
    np.add.at(steps, places, 1)
    np.add.at(steps, places + NEEDED, -1)
    covered = np.concatenate([[False], np.cumsum(steps[:-1]) > 0, [False]])
    edges = np.flatnonzero(covered[1:] != covered[:-1])
    return [(int(a), int(b)) for a, b in edges.reshape(-1, 2) if b - a >= LEAST]


def find_runs(words: list[bytes]) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence of words, by start and period."""
    if len(words) < LEAST:
        return []
    numbers: dict[bytes, int] = {}
    symbols = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    return [(low + start, length, period) for low, high in stretches(symbols) for start, length, period in runs_of(symbols[low:high].tolist())]


def highest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length / period; of equals the one that starts first, then the shorter period."""
    best = None
    for run in runs:  # by start and period
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    stays = np.ones(len(words), bool)
    for start, length, period in runs:
        stays[start + period : start + length] = False
    return [w for w, keep in zip(words, stays.tolist()) if keep]


_RUN = "struct<start: bigint, length: bigint, period: bigint>"
_ARROW_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add n_words, runs (all of them, by start and period), top_run (greatest length / period) and collapsed (the
    words that no run holds after its first period, joined by one space) to every row.

    Words are what space and 0x09-0x0D part. A null text or one without words has no runs and collapses to an
    empty string. Whole texts are read, however long: a text is worked on in one piece, and takes about half a
    kilobyte of memory for each word that repeated strings cover. Of runs that rise alike, top_run is the first.
    Repeated rows get the same answer, an empty table gives no rows. Columns that have the names of the results are
    replaced; all others pass through unchanged.
    """
    ship_code(docs.sparkSession)
    results = ("n_words", "runs", "top_run", "collapsed")
    kept = [c for c in docs.columns if c not in results]
    text = "text_of_words"
    while text in docs.columns:
        text += "_"
    schema = StructType([*docs.select(*kept).schema, *docs.sparkSession.createDataFrame([], f"n_words bigint, runs array<{_RUN}>, top_run {_RUN}, collapsed string").schema])

    def send(batch: pa.RecordBatch, at: int, found: list[tuple]) -> pa.RecordBatch:
        part = batch.slice(at, len(found))
        named = [[dict(zip(("start", "length", "period"), run)) for run in f[1]] for f in found]
        tops = [None if f[2] is None else dict(zip(("start", "length", "period"), f[2])) for f in found]
        arrays = [pa.array([f[0] for f in found], pa.int64()), pa.array(named, pa.list_(_ARROW_RUN)), pa.array(tops, _ARROW_RUN), pa.array([f[3] for f in found], pa.binary()).cast(pa.string())]
        return pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *arrays], names=[*kept, *results])

    def run(batches):
        for batch in batches:
            texts, at, found, size = batch.column(text), 0, [], 0
            for i in range(batch.num_rows):
                words = (texts[i].as_py() or b"").split()
                runs = find_runs(words)
                collapsed = b" ".join(collapse(words, runs))
                found.append((len(words), runs, highest(runs), collapsed))
                size += len(collapsed) + 24 * len(runs)
                if size > _FLUSH:
                    yield send(batch, at, found)
                    at, found, size = i + 1, [], 0
            yield send(batch, at, found)
        tidy()

    # what splits bytes in Python splits at exactly these six characters
    return docs.withColumn(text, F.col(text_col).cast("binary")).select(*kept, text).mapInArrow(run, schema)


def made_periodic(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """Text in which the ids that a hash picks continue one period from some word on; all other texts as they are."""
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(F.col(text_col), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))

    def continued(w: Column) -> Column:
        n = F.size(w)
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")

    # an array of one element gives the words a name, so that they are split once
    periodic = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, continued(w)).otherwise(""))[0]
    return F.when((h % 10 == 0) & F.col(text_col).isNotNull(), periodic).otherwise(F.col(text_col))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", made_periodic().alias("text"))
    found = periodic_runs(docs)
    line = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(line, F.lit("\n"))).otherwise("")
    top = F.col("top_run")
    exponent = F.floor(F.lit(1000) * top["length"] / top["period"])
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), top["start"].alias("start"), top["length"].alias("length"), top["period"].alias("period"),
        exponent.alias("exponent_milli"), F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
