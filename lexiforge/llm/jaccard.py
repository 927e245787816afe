"""Near duplicates by an exact Jaccard join of word shingles, with token-combination prefixes.

Tokens are fingerprints of word shingles, ordered from rare to frequent. Two sets that are similar enough
share a token of a short prefix in that order. A prefix indexes its rare tokens singly; of tokens that
very many texts share it indexes pairs, and is extended by one place for each class of such tokens, so
that a similar set must share either a rare token or a pair within a class.

How the data moves:

1. Shards of documents scatter their tokens to buckets by fingerprint, packed; a bucket learns which
   tokens other texts share, and how many do, and sends only those back to their shards. A token that many
   texts of a shard hold travels once for the shard, with its count.
2. A text whose prefix holds only tokens of its own is like no other. The others become nodes: one for
   each distinct set, so copies of a text cost one row each from here on.
3. Nodes that share a signature are compared with one pivot each, not with one another. Nearly all members
   of a family link with its pivot, which makes them one component.
4. What links without both being linked to the pivot is found in differences to the pivot's set. For sets
   u and v with the differences D(u) and D(v), the symmetric difference of u and v has
   |D(u)| + |D(v)| - 2 |D(u) & D(v)| tokens, so they are similar only if D(u) and D(v) have enough tokens in
   common. That is a second prefix join, on sets that hold just what tells the members of a family apart;
   tokens of a member's own, and places in the prefix too late for the overlap that a pair needs, drop out.
   Parities of the differences bound what two members do not share, so few pairs remain to be compared.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, mix64, text_blocks, tidy
from .graph import components

WORDS = 5
#: Similarity as a fraction: linked when DENOMINATOR * intersection >= NUMERATOR * union.
NUMERATOR, DENOMINATOR = 3, 4
#: Tokens in at least so many texts are frequent: indexed in pairs.
FREQUENT = 64
#: A token that so many texts of a shard hold stays there and travels as a count.
LOCALLY_HOT = 64
SHARD_BYTES = 8 << 20
SHARD_DOCS = 60_000
BUCKET_TOKENS = 1 << 20
#: What similar sets of n and m tokens must keep: (n + m) * _SAME >= |symmetric difference| * _ALL.
_SAME, _ALL = DENOMINATOR - NUMERATOR, DENOMINATOR + NUMERATOR

_rng = np.random.default_rng(20240229)
_BYTE_VALUES = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PLACES = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
_powers = np.ones(1, np.uint64)


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        with np.errstate(over="ignore"):
            _powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(max(n, 2 * len(_powers)), _STEP))])
    return _powers


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def shingle_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle fingerprints of each text: of ``words`` words, or of all if it has fewer.

    A-Z are lower-cased; words are runs of bytes other than space and 0x09-0x0D.
    """
    joined = np.frombuffer(b" ".join(texts).lower() + b" ", np.uint8)
    in_word = ~_SPACE[joined]
    edges = np.diff(np.concatenate([[False], in_word]).astype(np.int8))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    out = [np.zeros(0, np.uint64)] * len(texts)
    if not len(starts):
        return out
    sizes = ends - starts
    offsets = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    place = np.arange(int(sizes.sum())) - np.repeat(offsets, sizes)
    with np.errstate(over="ignore"):
        terms = _BYTE_VALUES[joined[in_word]] * _power_table(int(sizes.max()))[place]
        word = mix64(np.add.reduceat(terms, offsets) + sizes.astype(np.uint64))
        text_ends = np.cumsum([len(t) + 1 for t in texts])
        bounds = np.searchsorted(starts, text_ends)
        n = len(word)
        grams = np.zeros(max(n - words + 1, 0), np.uint64)
        for j in range(words):
            grams += word[j : n - words + 1 + j] * (_PLACES[j % 5] + np.uint64(2 * (j // 5)))
        grams = mix64(grams + np.uint64(words))
        lo = 0
        for i, hi in enumerate(bounds):
            count = hi - lo
            if count >= words:
                out[i] = np.unique(grams[lo : hi - words + 1])
            elif count:
                whole = sum((word[lo + j] * (_PLACES[j % 5] + np.uint64(2 * (j // 5))) for j in range(count)), np.uint64(0))
                out[i] = mix64(np.array([whole + np.uint64(count)], np.uint64))
            lo = hi
    return out


def set_id(tokens: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    with np.errstate(over="ignore"):
        total = mix64(tokens).sum(dtype=np.uint64) ^ (np.uint64(len(tokens)) * _STEP)
    return int(mix64(np.array([total]))[0].astype(np.int64))


def _planes(values: np.ndarray) -> bytes:
    """Rising 40-bit values as differences, split by bytes of like weight, which compress well."""
    steps = np.diff(values, prepend=np.uint64(0))
    return (steps & np.uint64(0xFFFF)).astype("<u2").tobytes() + ((steps >> np.uint64(16)) & np.uint64(0xFF)).astype("u1").tobytes() + (steps >> np.uint64(24)).astype("<u2").tobytes()


def _unplanes(raw: bytes, n: int) -> np.ndarray:
    low = np.frombuffer(raw, "<u2", n).astype(np.uint64)
    mid = np.frombuffer(raw, "u1", n, 2 * n).astype(np.uint64)
    high = np.frombuffer(raw[3 * n : 5 * n], "<u2", n).astype(np.uint64)
    return np.cumsum(low | (mid << np.uint64(16)) | (high << np.uint64(24)))


_MOVED = "bucket int, shard long, n int, payload binary"
#: The owner written for a token that stays in its shard.
_HELD_BACK = 0xFFFF


def level(counts: np.ndarray) -> np.ndarray:
    """Numbers of texts as bytes that keep their order: exact below 128, then eight steps to a doubling."""
    steps = 128 + np.floor(8 * np.log2(np.maximum(counts, 128) / 128))
    return np.minimum(np.where(counts < 128, counts, steps), 255).astype("u1")


def _record(ids, names, sizes, is_lead, hot_tokens, hot_owners) -> bytes:
    """What stays with a shard: its documents, and the owners of its hot tokens."""
    id_array = np.array([0 if i is None else i for i in ids], np.int64)
    id_null = np.array([i is None for i in ids], np.uint8)
    counts = np.array([len(o) for o in hot_owners], np.int64)
    about = [id_array, names, sizes, is_lead, id_null, np.array([len(hot_tokens)], np.int64), np.array(hot_tokens, np.uint64), counts, *hot_owners]
    return b"".join(x.tobytes() for x in about)


def _scatter(bits: int):
    """Documents to rows for buckets, and one row of what the shard keeps, filed under a negative bucket."""
    low = np.uint64(24 - bits)

    def flush(shard, ids, sets):
        names = np.array([set_id(s) if len(s) else 0 for s in sets], np.int64)
        sizes = np.array([len(s) for s in sets], np.int32)
        _, first = np.unique(names, return_index=True)
        leads = [i for i in first if sizes[i]]
        is_lead = np.zeros(len(sets), np.uint8)
        is_lead[leads] = 1
        rows, hot_tokens, hot_owners = [], [], []
        if leads:
            tokens = np.concatenate([sets[i] for i in leads]) >> low
            owner = np.repeat(np.array(leads, np.uint16), sizes[leads])
            order = np.argsort(tokens)
            tokens, owner = tokens[order], owner[order]
            starts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
            counts = np.diff(np.append(starts, len(tokens)))
            hot = np.flatnonzero(counts >= LOCALLY_HOT)
            times = np.zeros(len(tokens), np.uint32)
            stays = np.ones(len(tokens), bool)
            for at, count in zip(starts[hot], counts[hot]):
                hot_tokens.append(tokens[at])
                hot_owners.append(owner[at : at + count].copy())
                stays[at + 1 : at + count] = False
                owner[at], times[at] = _HELD_BACK, count
            tokens, owner, times = tokens[stays], owner[stays], times[stays]
            bucket, rest = tokens >> np.uint64(40), tokens & np.uint64((1 << 40) - 1)
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(tokens)]):
                held_back = times[lo:hi][times[lo:hi] > 0]
                rows.append((int(bucket[lo]), shard, hi - lo, _planes(rest[lo:hi]) + owner[lo:hi].astype("<u2").tobytes() + held_back.tobytes()))
        spread = int(mix64(np.array([shard], np.uint64))[0] & np.uint64((1 << bits) - 1))
        rows.append((-1 - spread, shard, len(ids), _record(ids, names, sizes, is_lead, hot_tokens, hot_owners)))
        return pd.DataFrame(rows, columns=["bucket", "shard", "n", "payload"])

    def run(batches):
        part, count = TaskContext.get().partitionId(), 0
        ids, sets, size = [], [], 0
        for batch in batches:
            for block_ids, block in text_blocks(batch["id"], batch["text"]):
                ids += [None if pd.isna(i) else int(i) for i in block_ids]
                sets += shingle_sets(block)
                size += sum(map(len, block))
                if size >= SHARD_BYTES or len(ids) >= SHARD_DOCS - 10_000:
                    for a in range(0, len(ids), SHARD_DOCS):
                        yield flush((part << 24) + count, ids[a : a + SHARD_DOCS], sets[a : a + SHARD_DOCS])
                        count += 1
                    ids, sets, size = [], [], 0
                    tidy()
        for a in range(0, len(ids), SHARD_DOCS):
            yield flush((part << 24) + count, ids[a : a + SHARD_DOCS], sets[a : a + SHARD_DOCS])
            count += 1
        ids, sets = [], []
        tidy()

    return run


def _shared(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """A bucket's answer to each shard: the tokens that another text has too, their texts, and how many have them."""
    bucket = key[0]
    if bucket < 0:
        return rows.assign(bucket=-1)
    rows = rows.sort_values("shard", kind="stable")
    counts = rows["n"].to_numpy()
    tokens = np.concatenate([_unplanes(p, n) for p, n in zip(rows["payload"], counts)])
    owner = np.concatenate([np.frombuffer(p, "<u2", n, 5 * n) for p, n in zip(rows["payload"], counts)])
    times = np.ones(len(tokens), np.int64)
    times[owner == _HELD_BACK] = np.concatenate([np.frombuffer(p, np.uint32, -1, 7 * n) for p, n in zip(rows["payload"], counts)])
    order = np.argsort(tokens, kind="stable")
    ordered = tokens[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    run = np.cumsum(new) - 1
    held = np.zeros(len(tokens), np.int64)
    held[order] = np.bincount(run, weights=times[order]).astype(np.int64)[run]
    out = []
    ends = np.cumsum(counts)
    for shard, lo, hi in zip(rows["shard"], ends - counts, ends):
        mine = lo + np.flatnonzero(held[lo:hi] > 1)
        if len(mine):
            out.append((bucket, shard, len(mine), _planes(tokens[mine]) + owner[mine].astype("<u2").tobytes() + level(held[mine]).tobytes()))
    return pd.DataFrame(out, columns=["bucket", "shard", "n", "payload"])


def prefix_length(n: int) -> int:
    """Places of a set of n tokens, one of which every similar set shares."""
    return n - -(-NUMERATOR * n // DENOMINATOR) + 1


def _classes(size_class: int) -> int:
    return max(1, (1 << size_class) >> 4)


def signatures(tokens: np.ndarray, frequency: np.ndarray, n: int) -> np.ndarray:
    """Signatures of a set of n tokens, of which ``tokens``, in the global order, are shared with others.

    Sets of a size class (a power of two) split frequent tokens into as many classes as their extension has
    places: with k classes and k further places, k + 1 common tokens must hold a rare one or two of a class.
    A pair of sets uses the size class of the smaller, so a set also serves the class below, if similar sets
    reach into it.
    """
    places = prefix_length(n) - (n - len(tokens))
    if places <= 0:
        return np.zeros(0, np.int64)
    frequent = frequency >= FREQUENT
    if not frequent[:places].any():
        return mix64(tokens[:places]).astype(np.int64)
    own = n.bit_length() - 1
    first = places + _classes(own)
    found = [mix64(tokens[:first][~frequent[:first]])]
    for size_class in (own, own - 1) if own and NUMERATOR * n < DENOMINATOR << own else (own,):
        k = _classes(size_class)
        common = np.sort(tokens[: places + k][frequent[: places + k]])
        group = mix64(common + np.uint64(1)) % np.uint64(k)
        order = np.argsort(group, kind="stable")
        common, group = common[order], group[order]
        cuts = np.flatnonzero(np.diff(group)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(common)]):
            a, b = np.triu_indices(hi - lo, 1)
            with np.errstate(over="ignore"):
                found.append(mix64(common[lo + a] * _PLACES[0] + common[lo + b] * _PLACES[1] + np.uint64(size_class + 1)))
    return np.unique(np.concatenate(found)).astype(np.int64)


_NODES = "doc_id long, name long, n int, tokens binary, levels binary, signatures array<long>"


def _assemble(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """A shard's documents; those that may resemble another text with their shared tokens and signatures."""
    about = rows[rows["bucket"] < 0].iloc[0]
    total, raw = int(about["n"]), about["payload"]
    ids, names = np.frombuffer(raw, np.int64, total), np.frombuffer(raw, np.int64, total, 8 * total)
    sizes, lead = np.frombuffer(raw, np.int32, total, 16 * total), np.frombuffer(raw, np.uint8, total, 20 * total)
    nulls = np.frombuffer(raw, np.uint8, total, 21 * total)
    n_hot = int(np.frombuffer(raw, np.int64, 1, 22 * total)[0])
    hot_tokens = np.frombuffer(raw, np.uint64, n_hot, 22 * total + 8)
    hot_counts = np.frombuffer(raw, np.int64, n_hot, 22 * total + 8 + 8 * n_hot)
    hot_owners = np.frombuffer(raw, np.uint16, -1, 22 * total + 8 + 16 * n_hot).astype(np.int64)
    packed: list = [None] * total
    levels: list = [None] * total
    marks: list = [None] * total
    answers = rows[rows["bucket"] >= 0]
    if len(answers):
        counts = answers["n"].to_numpy()
        tokens = np.concatenate([_unplanes(p, n) | (np.uint64(b) << np.uint64(40)) for b, n, p in zip(answers["bucket"], counts, answers["payload"])])
        owner = np.concatenate([np.frombuffer(p, "<u2", n, 5 * n) for n, p in zip(counts, answers["payload"])]).astype(np.int64)
        frequency = np.concatenate([np.frombuffer(p, "u1", n, 7 * n) for n, p in zip(counts, answers["payload"])])
        back = owner == _HELD_BACK
        if back.any():  # hot tokens meet their owners again
            held, their = tokens[back], frequency[back]
            order = np.argsort(held)
            their = np.repeat(their[order][np.searchsorted(held[order], hot_tokens)], hot_counts)
            tokens = np.concatenate([tokens[~back], np.repeat(hot_tokens, hot_counts)])
            owner = np.concatenate([owner[~back], hot_owners])
            frequency = np.concatenate([frequency[~back], their])
        # a text with too few shared tokens resembles none
        shared = np.bincount(owner, minlength=total)
        near = shared * DENOMINATOR >= sizes.astype(np.int64) * NUMERATOR
        keep = near[owner]
        tokens, owner, frequency = tokens[keep], owner[keep], frequency[keep]
        order = np.lexsort((tokens, frequency, owner))
        tokens, owner, frequency = tokens[order], owner[order], frequency[order]
        cuts = np.flatnonzero(np.diff(owner)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(owner)]):
            if hi > lo:
                found = signatures(tokens[lo:hi], frequency[lo:hi], int(sizes[owner[lo]]))
                if len(found):
                    by_token = np.argsort(tokens[lo:hi])
                    packed[owner[lo]], marks[owner[lo]] = tokens[lo:hi][by_token].tobytes(), found
                    levels[owner[lo]] = frequency[lo:hi][by_token].tobytes()
    doc_ids = pd.array(np.where(nulls == 1, 0, ids), dtype="Int64")
    doc_ids[nulls == 1] = pd.NA
    return pd.DataFrame({"doc_id": doc_ids, "name": names, "n": sizes, "tokens": packed, "levels": levels, "signatures": marks})


def _with_tokens(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (u, p, ...) with the sets of both."""
    one = nodes.select(F.col("name").alias("u"), F.col("tokens").alias("a"), F.col("levels").alias("a_levels"), "n")
    other = nodes.select(F.col("name").alias("p"), F.col("tokens").alias("b"), F.col("levels").alias("b_levels"), F.col("n").alias("m"))
    return pairs.join(one, "u").join(other, "p")


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """Members that two sorted sets share."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 0
    return int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())


def _compared(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(u, p, linked): whether the sets of u and p are similar."""

    def run(batches):
        for batch in batches:
            linked = []
            for a, b, n, m in zip(batch["a"], batch["b"], batch["n"], batch["m"]):
                both = _common(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64))
                linked.append(DENOMINATOR * both >= NUMERATOR * (int(n) + int(m) - both))
            yield batch[["u", "p"]].assign(linked=linked)

    return _with_tokens(pairs, nodes).select("u", "p", "a", "b", "n", "m").mapInPandas(run, "u long, p long, linked boolean")


_NEAR = np.uint64(0)
#: 64-bit words of a difference's parities: bit i says whether it has an odd number of tokens in cell i. Two
#: differences disagree in a cell only if a token there is in one of them alone.
_PARITY_WORDS = 8
_DIFFERENCE = "u long, p long, component long, outside boolean, n int, d int, own int, place int, token long, " + ", ".join(f"parity{i} long" for i in range(_PARITY_WORDS))


def least_overlap(d: int, own_size: int, n_p: int, s_p: int, linked: bool) -> int:
    """Tokens that D(u) must share with D(v) of any v that u is similar to, unless both are linked to p. It is
    0 or less for a u so near to p that it may need none, as p has tokens of its own.

    With c = _SAME / _ALL, u and v are similar if |D(u)| + |D(v)| - 2 overlap <= c (n_u + n_v); differences are
    taken to the s_p tokens of p that others hold too. One of the two is not linked to p, say w:
    |D(w)| - c n_w > c n_p - (n_p - s_p). For u linked to p that bounds the overlap with any w. If u is not,
    |D(v)| - c n_v >= -c s_p for every v, and D(v) >= D(u) - c (n_u + n_v) where n_v <= n_u DENOMINATOR / NUMERATOR.
    """
    left = _ALL * d - _SAME * own_size
    if linked:
        least = (left + _SAME * n_p - _ALL * (n_p - s_p)) / (2 * _ALL)
    else:
        least = max((left - _SAME * s_p) / (2 * _ALL), d - _SAME * own_size * (1 + DENOMINATOR / NUMERATOR) / _ALL)
    return int(np.ceil(least - 1e-9))


def difference_prefix(a, a_levels, b, b_levels, n: int, m: int, linked: bool) -> tuple[int, int, np.ndarray, np.ndarray]:
    """(|D|, tokens of its own, prefix of the others, parities of the others) of a set of n tokens against p's: what another set's
    prefix must share a token with. Added tokens come first, rare ones before frequent ones, then missing ones.
    Sets that may need none to link share the token _NEAR."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    added, missing = ~np.isin(x, y, assume_unique=True), ~np.isin(y, x, assume_unique=True)
    own = n - len(x)
    d = own + int(added.sum()) + int(missing.sum())
    least = least_overlap(d, n, m, len(y), linked)
    near = np.full(int(least <= 0), _NEAR)
    least = max(least, 1)
    places = d - least + 1 - own
    if places <= 0 or d - own < least:
        return d, own, near, _parities(x[added], y[missing])
    x, y = x[added], y[missing]
    x = x[np.lexsort((x, np.frombuffer(a_levels, "u1")[added]))]
    y = y[np.lexsort((y, np.frombuffer(b_levels, "u1")[missing]))]
    return d, own, np.concatenate([np.concatenate([x, y])[:places], near]), _parities(x, y)


def _parities(*tokens: np.ndarray) -> np.ndarray:
    cells = mix64(np.concatenate(tokens)) % np.uint64(64 * _PARITY_WORDS)
    odd = np.bincount(cells.astype(np.int64), minlength=64 * _PARITY_WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _differences(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows for each token of the prefix of u's difference to p, for pairs (u, p, linked, component)."""

    def run(batches):
        for batch in batches:
            found = [difference_prefix(*x) for x in zip(*(batch[c] for c in ("a", "a_levels", "b", "b_levels", "n", "m", "linked")))]
            sizes = np.array([len(prefix) for _, _, prefix, _ in found], np.int64)
            if not sizes.sum():
                continue
            token = np.concatenate([prefix for _, _, prefix, _ in found])
            place = np.arange(len(token)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            about = batch[["u", "p", "component", "n"]].assign(outside=~batch["linked"].astype(bool), d=[d for d, *_ in found], own=[own for _, own, *_ in found])
            parities = pd.DataFrame(np.stack([words for *_, words in found]), columns=[f"parity{i}" for i in range(_PARITY_WORDS)], index=about.index)
            rows = pd.concat([about, parities], axis=1).loc[np.repeat(about.index.to_numpy(), sizes)]
            yield rows.assign(place=np.where(token == _NEAR, 0, place), token=token.astype(np.int64))

    wide = _with_tokens(pairs, nodes).select("u", "p", "linked", "component", "a", "a_levels", "b", "b_levels", "n", "m")
    return wide.mapInPandas(run, _DIFFERENCE)


def _may_link() -> Column:
    """Whether u and v, whose differences share the token at the places ``place`` and ``place_v``, can be similar:
    sizes within the similarity, from these places on shared tokens enough for the overlap that they need, and
    no more tokens in one of them alone, by their own tokens and parities, than similar sets have."""
    n, m = F.col("n"), F.col("n_v")
    sizes = (n * DENOMINATOR >= m * NUMERATOR) & (m * DENOMINATOR >= n * NUMERATOR)
    rest = F.least(F.col("d") - F.col("own") - F.col("place"), F.col("d_v") - F.col("own_v") - F.col("place_v"))
    enough = 2 * _ALL * rest >= _ALL * (F.col("d") + F.col("d_v")) - _SAME * (n + m)
    alone = F.col("own") + F.col("own_v")
    for i in range(_PARITY_WORDS):
        alone = alone + F.bit_count(F.col(f"parity{i}").bitwiseXOR(F.col(f"parity{i}_v")))
    return sizes & enough & (_ALL * alone <= _SAME * (n + m))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id.

    Documents link when their sets of distinct 5-word shingles have a Jaccard similarity of 0.75 or more; a
    component is what links connect, named by its smallest doc_id. Null, empty and wordless texts have an
    empty set and link with nothing (component_id is their own id). Repeated rows are copies that link. A
    null id gets its component's smallest id, if any. An empty table gives no rows. Other columns are not
    looked at. docs should be a stored table, so that a repeated task reads its rows in the same order.
    Very long texts are read whole, in blocks of their own. Ties do not arise: every pair that links counts.
    Sets are compared by fingerprints of 46 to 64 bits: 40, and those of the bucket, whose number follows the
    input. A token that meets an unlike one of the same fingerprint (with 10**8 distinct tokens in 47 bits about
    one in 1.4 million) counts as shared, which can move a pair's overlap by one.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    total = narrow.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(24, max(6, (total // 6 // BUCKET_TOKENS).bit_length()))
    moved = narrow.mapInPandas(_scatter(bits), _MOVED).groupBy("bucket").applyInPandas(_shared, _MOVED)
    found = scratch.store(moved.groupBy("shard").applyInPandas(_assemble, _NODES), "documents")
    links = _links(found, scratch)
    members = found.select("doc_id", "n", F.when(F.col("n") > 0, F.col("name")).alias("name"))
    # the least id of each component, by way of the distinct sets: rows of copies are summed up before they travel
    sets = members.filter("name IS NOT NULL").groupBy("name").agg(F.min("doc_id").alias("least"))
    named = sets.join(links.select(F.col("node").alias("name"), "component"), "name", "left").withColumn("component", F.coalesce("component", "name"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    answers = named.join(smallest, "component").select("name", "component_id")
    return members.join(answers, "name", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )


def _links(found: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of all distinct sets that have a link."""
    with_tokens = found.filter("tokens IS NOT NULL")
    one = F.first(F.struct("n", "tokens", "levels", "signatures")).alias("x")
    nodes = scratch.store(with_tokens.groupBy("name").agg(one).select("name", "x.*"), "nodes")
    # Edits give a copy tokens of its own, so the text with the fewest is nearest to the centre of its group.
    # All signatures of a group mostly agree on it; a hash decides between equals.
    own = F.floor(64 * (F.col("n") - F.length("tokens") / 8) / F.col("n")).alias("own")
    marks = nodes.select(own, F.xxhash64("name").alias("h"), "name", F.explode("signatures").alias("signature"))
    pivots = marks.groupBy("signature").agg(F.min(F.struct("own", "h", "name")).alias("pivot"), F.max("name").alias("hi"), F.min("name").alias("lo")).filter("lo <> hi")
    met = marks.join(pivots, "signature").select(F.col("name").alias("u"), F.col("pivot.name").alias("p")).filter("u <> p").distinct()
    compared = scratch.store(_compared(met, nodes), "compared")
    links = compared.filter("linked").select("u", F.col("p").alias("v"))
    labels = scratch.store(components(links, scratch), "labels")
    # groups that their pivot has not made one component
    label = labels.select(F.col("node").alias("u"), "component")
    whole = compared.unionByName(compared.select(F.col("p").alias("u"), "p", F.lit(True).alias("linked")).distinct())
    whole = whole.join(label, "u", "left").withColumn("component", F.coalesce("component", "u"))
    mixed = whole.groupBy("p").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.bool_and("linked").alias("settled")).filter("lo <> hi AND NOT settled").select("p")
    rows = scratch.store(_differences(whole.filter("u <> p").join(mixed, "p", "left_semi").select("u", "p", "linked", "component"), nodes), "differences")
    if not rows.seen["n_rows"]:
        scratch.drop(nodes, compared, rows)
        return labels
    others = rows.select("p", "token", *(F.col(c).alias(f"{c}_v") for c in rows.columns if c not in ("p", "token")))
    new = (F.col("component") != F.col("component_v")) & (~F.col("outside_v") | (F.col("u") < F.col("u_v")))
    pairs = rows.filter("outside").join(others, ["p", "token"]).filter(new & _may_link())
    pairs = pairs.select(F.col("u"), F.col("u_v").alias("p")).distinct()
    more = scratch.store(_compared(pairs, nodes).filter("linked"), "more")
    found = components(links.unionByName(more.select("u", F.col("p").alias("v"))), scratch) if more.seen["n_rows"] else labels
    scratch.drop(nodes, compared, rows, more)
    return found


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
