"""Suffix arrays of byte strings in numpy: sorting by refinement, common prefixes, merging by binary search."""

from __future__ import annotations

import numpy as np

#: Steps that every lane of the lock-step Kasai scan takes.
_LANE = 256


def words_at(text: np.ndarray) -> np.ndarray:
    """The big-endian 64-bit word at every byte, zeros behind the end."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    n = len(text)
    out = np.zeros(n, np.uint64)
    for k in range(8):
        out |= padded[k : k + n] << np.uint64(8 * (7 - k))
    return out


def _equal_bytes(differ: np.ndarray) -> np.ndarray:
    """How many leading bytes of the 64-bit values are zero."""
    high, low = differ >> np.uint64(32), differ & np.uint64(0xFFFFFFFF)
    # the exponent of a 32-bit number is its length in bits
    bits = np.where(high > 0, np.frexp(high.astype(np.float64))[1] + 32, np.frexp(low.astype(np.float64))[1])
    return 8 - (bits + 7) // 8


def suffix_array(text: np.ndarray) -> np.ndarray:
    """All suffixes in order; one that is a prefix of another sorts first.

    Larsson-Sadakane refinement: groups that agree on h bytes are told apart by the ranks of what follows,
    which doubles h; suffixes alone in their group are final and leave the work.
    """
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    first = words_at(text)
    order = np.argsort(first)
    # of equal words, those that reach behind the end come first, the shorter before the longer
    ordered = first[order]
    for word in np.unique(first[max(n - 7, 0) :]):
        lo, hi = np.searchsorted(ordered, word, "left"), np.searchsorted(ordered, word, "right")
        order[lo:hi] = order[lo:hi][np.argsort(np.minimum(n - order[lo:hi], 8), kind="stable")]
    known = np.minimum(n - order, 8)
    starts = np.flatnonzero(np.concatenate([[True], (first[order][1:] != first[order][:-1]) | (known[1:] != known[:-1])]))
    sizes = np.diff(np.append(starts, n))
    rank = np.zeros(n + 1, np.int64)  # 0 is behind the end
    rank[order] = np.repeat(starts, sizes) + 1
    slots = np.flatnonzero(np.repeat(sizes > 1, sizes))  # places in order whose group is not single
    h = 8
    while len(slots):
        members = order[slots]
        group = rank[members]
        following = rank[np.minimum(members + h, n)]
        resort = np.argsort(group * (n + 1) + following)  # both are places in the text
        members, group, following = members[resort], group[resort], following[resort]
        order[slots] = members
        starts = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (following[1:] != following[:-1])]))
        sizes = np.diff(np.append(starts, len(members)))
        rank[members] = np.repeat(slots[starts], sizes) + 1
        slots = slots[np.repeat(sizes > 1, sizes)]
        h *= 2
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """For each place k > 0 of the suffix array, the common prefix of its suffix with the one before, up to ``most``.

    Kasai's scan in text order, where a prefix is at most one shorter than at the byte before; the text is
    cut into lanes that scan in step.
    """
    n = len(text)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    words = words_at(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    lanes = np.arange(0, n, _LANE)
    length = np.zeros(len(lanes), np.int64)
    by_place = np.zeros(n, np.int64)
    for step in range(_LANE):
        i = lanes + step
        alive = i < n
        i, length = i[alive], length[alive]
        lanes = lanes[alive]
        j = before[i]
        length[j < 0] = 0
        going = np.flatnonzero((j >= 0) & (length < most))
        while len(going):
            a, b = i[going] + length[going], j[going] + length[going]
            room = n - np.maximum(a, b)
            inside = room > 0
            going, a, b, room = going[inside], a[inside], b[inside], room[inside]
            same = np.minimum(_equal_bytes(words[a] ^ words[b]), room)
            length[going] += same
            going = going[(same == 8) & (length[going] < most)]
        by_place[i] = np.minimum(length, most)
        length = np.maximum(length - 1, 0)
    out[1:] = by_place[order[1:]]
    return out


class SortedShard:
    """A shard's texts with their suffix array, and the classes of equal strings of ``size`` bytes."""

    def __init__(self, texts: list[bytes], size: int):
        self.size = size
        self.text = np.frombuffer(b"".join(texts), np.uint8)
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.order = suffix_array(self.text)
        n = len(self.text)
        left = np.repeat(self.starts + self.lengths, self.lengths) - np.arange(n)
        self.whole = left >= size  # a string of full size starts here, within its text
        prefix = common_prefixes(self.text, self.order, size)
        self.class_of_place = np.cumsum(prefix < size) - 1 if n else np.zeros(0, np.int64)
        self.class_of = np.zeros(n, np.int64)
        self.class_of[self.order] = self.class_of_place
        count = np.bincount(self.class_of[self.whole], minlength=int(self.class_of_place[-1]) + 1 if n else 0)
        self.held = count > 0
        self.repeated = count > 1
        self.words = words_at(self.text)

    def representatives(self) -> np.ndarray:
        """One start of each class that has a whole string."""
        places = self.order[self.whole[self.order]]
        _, first = np.unique(self.class_of[places], return_index=True)
        return places[first]

    def _compare(self, mine: np.ndarray, other: SortedShard, theirs: np.ndarray) -> np.ndarray:
        """-1, 0 or 1: strings of full size here against suffixes of the other shard."""
        out = np.zeros(len(mine), np.int64)
        open_ = np.arange(len(mine))
        for at in range(0, self.size, 8):
            width = min(8, self.size - at)
            a = self.words[mine[open_] + at] >> np.uint64(8 * (8 - width))
            place = theirs[open_] + at
            ended = place >= len(other.text)
            b = np.where(ended, np.uint64(0), other.words[np.minimum(place, len(other.text) - 1)]) >> np.uint64(8 * (8 - width))
            # a suffix that ends sorts before what it is a prefix of
            short = len(other.text) - place < width
            result = np.where(a < b, -1, np.where((a > b) | short, 1, 0))
            out[open_] = result
            open_ = open_[result == 0]
            if not len(open_):
                break
        return out

    def merge(self, other: SortedShard) -> None:
        """Mark classes that both shards hold as repeated: each string is searched in the other's suffix array."""
        mine = self.representatives()
        if not len(mine) or not len(other.text):
            return
        lo, hi = np.zeros(len(mine), np.int64), np.full(len(mine), len(other.order), np.int64)
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            middle = (lo[open_] + hi[open_]) // 2
            greater = self._compare(mine[open_], other, other.order[middle]) > 0
            lo[open_[greater]] = middle[greater] + 1
            hi[open_[~greater]] = middle[~greater]
        inside = lo < len(other.order)
        mine, lo = mine[inside], lo[inside]
        equal = self._compare(mine, other, other.order[lo]) == 0
        mine, theirs = self.class_of[mine[equal]], other.class_of_place[lo[equal]]
        both = other.held[theirs]
        self.repeated[mine[both]] = True
        other.repeated[theirs[both]] = True

    def flags(self) -> list[np.ndarray]:
        """For each text, which of its bytes start a repeated string."""
        marks = self.repeated[self.class_of] & self.whole if len(self.text) else np.zeros(0, bool)
        return [marks[a : a + n] for a, n in zip(self.starts, self.lengths)]


def repeated_starts(texts: list[bytes], size: int, shard_bytes: int) -> list[np.ndarray]:
    """For each text, which bytes start a string of ``size`` bytes that starts elsewhere too, in any of the texts."""
    shards, part, held = [], [], 0
    for t in texts:
        if part and held + len(t) > shard_bytes:
            shards.append(SortedShard(part, size))
            part, held = [], 0
        part.append(t)
        held += len(t)
    if part:
        shards.append(SortedShard(part, size))
    for k, shard in enumerate(shards):
        for other in shards[k + 1 :]:
            shard.merge(other)
    return [f for shard in shards for f in shard.flags()]
