"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces with log scores.

A model file of the unigram kind holds log probabilities, and gives the ids of SentencePiece. One of the BPE
kind holds merge ranks, which are no log scores: its pieces get the log probabilities that Zipf's law gives to
their ranks, 1 / (rank + 1) in proportion. No vocabulary is trained here.
"""

from __future__ import annotations

import math
import re
import struct
import zlib
from array import array
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship_code

MARKER = "▁"
#: How far a character that no piece covers scores below the worst piece.
UNKNOWN_PENALTY = 10.0
_ODD_SPACES = re.compile(r"(?:^|[ \n]) | (?:$|\n)|^\n")
_CACHE_LIMIT = 400_000


#: Bytes of a word without spaces after which the part of the path that is certain is written out.
_WINDOW = 1 << 16
#: Log scores are multiples of this, so that sums are exact and equal scores stay equal.
_GRAIN = 1 / 256
#: Numbers in the file format: kinds of models and of pieces.
_UNIGRAM, _BPE = 1, 2
_NORMAL, _UNKNOWN, _USER_DEFINED, _BYTE = 1, 2, 4, 6


@dataclass
class Pieces:
    """A vocabulary: pieces with log scores, the ids of the 256 byte pieces (or none) and of the unknown piece."""

    pieces: list[str]
    scores: list[float]
    usable: list[bool]
    byte_ids: list[int] | None
    unknown: int


def _fields(raw: bytes):
    """(number, value) of the fields of a protocol buffer message."""

    def varint(at):
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(raw):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if kind == 2 else (8 if kind == 1 else 4, at)
            value = raw[at : at + size]
            at += size
        yield key >> 3, value


def zipf_scores(ranks: list[float]) -> list[float]:
    """Log probabilities of pieces that are in proportion to 1 / (rank + 1)."""
    total = math.log(math.fsum(1 / (r + 1) for r in ranks)) if ranks else 0.0
    return [round((-math.log(r + 1) - total) / _GRAIN) * _GRAIN for r in ranks]


def read_pieces(path: str) -> Pieces:
    """The vocabulary of a SentencePiece model file."""
    pieces, scores, kinds, model_kind = [], [], [], _UNIGRAM
    with open(path, "rb") as file:
        raw = file.read()
    for number, value in _fields(raw):
        if number == 1:
            held = dict(_fields(value))
            pieces.append(held.get(1, b"").decode())
            scores.append(struct.unpack("<f", held[2])[0] if 2 in held else 0.0)
            kinds.append(held.get(3, _NORMAL))
        elif number == 2:
            model_kind = dict(_fields(value)).get(3, _UNIGRAM)
    usable = [k in (_NORMAL, _USER_DEFINED) for k in kinds]
    if model_kind == _BPE:
        order = sorted((i for i, u in enumerate(usable) if u), key=lambda i: -scores[i])
        for i, score in zip(order, zipf_scores(list(range(len(order))))):
            scores[i] = score
    elif model_kind != _UNIGRAM:
        raise ValueError("a model of words or characters has no log scores")
    by_byte = {pieces[i]: i for i, k in enumerate(kinds) if k == _BYTE}
    byte_ids = [by_byte[f"<0x{b:02X}>"] for b in range(256)] if len(by_byte) == 256 else None
    return Pieces(pieces, scores, usable, byte_ids, kinds.index(_UNKNOWN) if _UNKNOWN in kinds else 0)


class DoubleArray:
    """A trie over byte strings: the child of node s by byte c is t = base[s] + c, if check[t] == s.

    value[t] is the id of the key that ends at t, or -1. Keys are inserted breadth first, so a node's
    children are placed at once, at a base where all their cells are free.
    """

    def __init__(self, keys: list[tuple[bytes, int]]):
        self.base, self.check, self.value = array("i", [0] * 512), array("i", [-1] * 512), array("i", [-1] * 512)
        self.check[0] = 0
        keys = sorted(keys)
        look = 1  # cells before it are nearly all taken
        level = [(0, 0, len(keys), 0)]  # node, its range of keys, depth
        while level:
            following = []
            for node, lo, hi, depth in level:
                while lo < hi and len(keys[lo][0]) == depth:
                    self.value[node] = keys[lo][1]
                    lo += 1
                children: list[list[int]] = []
                for k in range(lo, hi):
                    c = keys[k][0][depth]
                    if children and children[-1][0] == c:
                        children[-1][2] = k + 1
                    else:
                        children.append([c, k, k + 1])
                if not children:
                    continue
                lead = children[0][0]
                at, taken, started = max(look, lead + 1), 0, False
                while True:
                    self._grow(at + 256)
                    if self.check[at] >= 0:
                        taken += 1
                    else:
                        if not started:
                            look, started = at, True
                        base = at - lead
                        if all(self.check[base + c] < 0 for c, _, _ in children):
                            break
                    at += 1
                if taken > 0.95 * (at - look + 1):
                    look = at
                self.base[node] = base
                for c, a, b in children:
                    self.check[base + c] = node
                    following.append((base + c, a, b, depth + 1))
            level = following

    def _grow(self, size: int) -> None:
        while len(self.check) <= size:
            more = len(self.check)
            self.base.extend([0] * more)
            self.check.extend([-1] * more)
            self.value.extend([-1] * more)


class _Words(dict):
    """word -> ids of prefix + word, as bytes of 32-bit integers."""

    def __init__(self, solve, prefix: str):
        super().__init__()
        self.solve, self.prefix = solve, prefix

    def __missing__(self, word: str) -> bytes:
        if len(self) >= _CACHE_LIMIT:
            self.clear()
        found = self[word] = self.solve(self.prefix + word).tobytes() if self.prefix + word else b""
        return found


class Codec:
    """Encodes and decodes texts. The text is spelled with markers for spaces, and one in front.

    Decoding gives the text back, whatever it holds, if the vocabulary has byte pieces: what no piece
    spells, and a marker character of the text itself, is written in bytes.
    """

    def __init__(self, vocabulary: Pieces):
        self.v = vocabulary
        keys = [(p.encode(), i) for i, p in enumerate(vocabulary.pieces) if vocabulary.usable[i] and p]
        self.trie = DoubleArray(keys)
        self.longest = max((len(k) for k, _ in keys), default=0) + 4  # or an unknown character
        self.unknown_score = min((vocabulary.scores[i] for _, i in keys), default=0.0) - UNKNOWN_PENALTY
        # no piece reaches over "other, marker": the best path is made of the best paths of the words
        self.by_word = not any(MARKER in p.lstrip(MARKER) for i, p in enumerate(vocabulary.pieces) if vocabulary.usable[i])
        self.by_line = self.by_word and vocabulary.byte_ids is not None and not any("\n" in p for i, p in enumerate(vocabulary.pieces) if vocabulary.usable[i])
        self.marked, self.bare = _Words(self.viterbi, MARKER), _Words(self.viterbi, "")
        self.spelled = [(p.replace(MARKER, " ") if vocabulary.usable[i] else "").encode() for i, p in enumerate(vocabulary.pieces)]
        self.spelled[vocabulary.unknown] = " ⁇ ".encode()
        for b, i in enumerate(vocabulary.byte_ids or []):
            self.spelled[i] = bytes([b])

    def viterbi(self, text: str) -> array:
        """Ids of the best path; of paths that score alike, the one whose last pieces start first.

        A long word is solved with bounded memory: every window, what all open paths have in common is written.
        """
        raw = text.encode("utf-8", "surrogatepass")
        n = len(raw)
        base, check, value, scores = self.trie.base, self.trie.check, self.trie.value, self.v.scores
        lowest = float("-inf")
        out = array("i")
        origin, at = 0, 0  # the lists start at the place origin, up to which ids are written
        room = min(n, _WINDOW + self.longest)
        best, start_of, key_of = [lowest] * (room + 1), [0] * (room + 1), [-1] * (room + 1)
        best[0] = 0.0
        size = len(check)
        while at < n:
            lead = raw[at]
            width = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            here, node, to, covers = best[at - origin], 0, at, False
            while to < n:
                child = base[node] + raw[to]
                if child >= size or check[child] != node or not child:
                    break
                node = child
                to += 1
                key = value[node]
                if key >= 0:
                    if to - at == width:
                        covers = True
                    total = here + scores[key]
                    if total > best[to - origin]:
                        best[to - origin], start_of[to - origin], key_of[to - origin] = total, at, key
            if not covers:
                total, to = here + self.unknown_score, at + width - origin
                if total > best[to]:
                    best[to], start_of[to], key_of[to] = total, at, -1
            at += width
            if at - origin >= _WINDOW and at < n:
                ends = {t for t in range(at, min(n, at + self.longest) + 1) if t - origin < len(best) and best[t - origin] > lowest}
                while len(ends) > 1:
                    last = max(ends)
                    ends.remove(last)
                    ends.add(start_of[last - origin])
                settled = ends.pop()
                self._write(raw, origin, settled, start_of, key_of, out)
                more = [lowest] * (at - settled + _WINDOW + self.longest + 1 - (len(best) - (settled - origin)))
                best = best[settled - origin :] + more
                start_of, key_of = start_of[settled - origin :] + [0] * len(more), key_of[settled - origin :] + [-1] * len(more)
                origin = settled
        self._write(raw, origin, n, start_of, key_of, out)
        return out

    def _write(self, raw: bytes, origin: int, to: int, start_of: list[int], key_of: list[int], out: array) -> None:
        """Append the ids of the path from origin to a place."""
        spans = []
        while to > origin:
            start = start_of[to - origin]
            spans.append((start, to, key_of[to - origin]))
            to = start
        for start, to, key in reversed(spans):
            if key >= 0:
                out.append(key)
            elif self.v.byte_ids:
                out.extend(self.v.byte_ids[b] for b in raw[start:to])
            else:
                out.append(self.v.unknown)

    def encode(self, text: str | None) -> array:
        """Ids of the whole text. Null and empty texts have none."""
        out = array("i")
        if not text:
            return out
        if self.by_line and MARKER not in text and not _ODD_SPACES.search(text):
            # single spaces only: each word has its marker; no piece reaches over a line feed
            parts = []
            for k, line in enumerate(text.split("\n")):
                first, *rest = line.split(" ")
                if k:
                    parts.append(self.bare["\n"])
                parts.append(self.bare[first] if k else self.marked[first])
                parts.extend(map(self.marked.__getitem__, rest))
            out.frombytes(b"".join(parts))
            return out
        for k, part in enumerate(text.split(MARKER)):
            if k:
                out.extend(self.v.byte_ids[b] for b in MARKER.encode()) if self.v.byte_ids else out.append(self.v.unknown)
            spelled = (MARKER if not k else "") + part.replace(" ", MARKER)
            if not self.by_word:
                out.extend(self.viterbi(spelled))
                continue
            pending = ""
            for j, word in enumerate(spelled.split(MARKER)):
                if j:
                    pending += MARKER
                if word:
                    out.frombytes(self.bare[pending + word])
                    pending = ""
            if pending:
                out.frombytes(self.bare[pending])
        return out

    def decode(self, ids) -> str:
        """The text of ids: byte pieces are put together, markers become spaces, the first one goes."""
        raw = b"".join(map(self.spelled.__getitem__, ids))
        in_front = len(ids) and self.v.usable[ids[0]] and raw[:1] == b" "
        return raw[1 if in_front else 0 :].decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(read_pieces(path))


def vocabulary_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None) -> DataFrame:
    """One row per row of docs: id, ids (array of int), decoded (the text of the ids).

    Whole texts are encoded, also very long ones without a space. Null and empty texts give no ids and an empty
    text. Of paths that score alike, the one whose last pieces start first is taken. Rows are independent:
    repeated ones give repeated results, an empty table none; other columns are not looked at. The
    vocabulary is read from ``model_path`` on each executor and kept there for later tasks.
    """
    ship_code(docs.sparkSession)
    path = model_path or vocabulary_path()

    def run(batches):
        tool = codec(path)
        for batch in batches:
            ids = [tool.encode(t) for t in batch["text"]]
            yield pd.DataFrame({"id": batch["id"], "ids": [np.frombuffer(x, np.int32) for x in ids], "decoded": [tool.decode(x) for x in ids]})

    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInPandas(run, "id long, ids array<int>, decoded string")


def digest_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None) -> DataFrame:
    """As encode_documents, with counts and checksums in place of the ids and texts: id, n_tokens,
    n_byte_tokens (written as bytes), ids_crc32 (of little-endian 32-bit ids), n_bytes, round_trip."""
    ship_code(docs.sparkSession)
    path = model_path or vocabulary_path()

    def run(batches):
        tool = codec(path)
        is_byte = np.zeros(len(tool.v.pieces), bool)
        is_byte[tool.v.byte_ids or []] = True
        for batch in batches:
            rows = []
            for i, text in zip(batch["id"], batch["text"]):
                text = text or ""
                ids = tool.encode(text)
                in_bytes = int(is_byte[np.frombuffer(ids, np.int32)].sum()) if ids else 0
                rows.append((i, len(ids), in_bytes, zlib.crc32(ids.tobytes()), len(text.encode("utf-8", "surrogatepass")), tool.decode(ids) == text))
            yield pd.DataFrame(rows, columns=["id", "n_tokens", "n_byte_tokens", "ids_crc32", "n_bytes", "round_trip"])

    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInPandas(run, "id long, n_tokens int, n_byte_tokens int, ids_crc32 long, n_bytes long, round_trip boolean")


def query(spark, sf_dir: str) -> DataFrame:
    found = digest_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.withColumnRenamed("id", "doc_id")
