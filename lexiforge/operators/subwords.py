"""Byte-level subwords: byte-pair merges over the distinct words of a part of a corpus, or of all of it.

Texts are encoded where they are: a worker merges each distinct word of a part of a batch, and keeps words that it has
merged. Counts and candidates merge a word once, however often the corpus holds it, and are joined by word. Words are
what the usual pattern of byte-level vocabularies cuts: a contraction, or a run of letters, digits or signs with the
space before it, or white space.
"""

from __future__ import annotations

import heapq
import json
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from ..functions.batches import parts
from ..functions.shipping import ship_code
from .sequences import byte_characters, placed_forms

#: Fixed value: how byte-level vocabularies cut texts (white space as Unicode has it).
WORDS = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries of a vocabulary that is sent to all workers, at most.
MOST_TOKENS = 1_000_000
#: Merged words that a worker keeps, at most, and the characters of one. When it has so many, it begins anew.
MOST_KEPT, KEPT_LENGTH = 200_000, 40
#: Values (words or ids) that a worker has as objects at a time; a longer text has all of its own.
PART_VALUES = 1 << 18


@dataclass
class Vocabulary:
    """ids: of each token, in printable characters for its bytes; ranks: of each pair that is merged."""

    ids: dict[str, int]
    ranks: dict[tuple[str, str], int]
    specials: dict[str, int] = field(default_factory=dict)

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """A file of the ``tokenizers`` library with a byte-level BPE model. Strings of special tokens are ordinary text."""
        with open(path, encoding="utf-8") as f:
            about = json.load(f)
        model = about["model"]
        if model["type"] != "BPE" or (about.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or about.get("normalizer"):
            raise ValueError(f"not a byte-level BPE vocabulary: {path}")
        if len(model["vocab"]) > MOST_TOKENS:
            raise ValueError(f"more than {MOST_TOKENS} tokens")
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        specials = {t["content"]: t["id"] for t in about.get("added_tokens", []) if t["special"]}
        return cls(model["vocab"], {pair: k for k, pair in enumerate(pairs)}, specials)

    @cached_property
    def _characters(self) -> list[str]:
        return byte_characters()

    @cached_property
    def _bytes(self) -> dict[str, int]:
        return {c: b for b, c in enumerate(self._characters)}

    @cached_property
    def _kept(self) -> dict[str, list[int]]:
        return {}

    @cached_property
    def _decoded(self) -> dict[int, bytes]:
        """The bytes of each id; special tokens have none."""
        found = {i: bytes(map(self._bytes.__getitem__, t)) for t, i in self.ids.items() if self._bytes.keys() >= set(t)}
        return found | {i: b"" for i in self.specials.values()}

    def merge(self, word: str) -> list[str]:
        """The tokens of a word: of all neighbouring pairs the one of least rank becomes one, the leftmost first,
        until no pair has a rank."""
        parts: list[str | None] = [self._characters[b] for b in word.encode("utf-8", "surrogatepass")]
        n = len(parts)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        ranks = self.ranks
        heap = [(rank, k, parts[k], parts[k + 1]) for k in range(n - 1) if (rank := ranks.get((parts[k], parts[k + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, a, b = heapq.heappop(heap)
            right = after[k]
            if parts[k] != a or right >= n or parts[right] != b:
                continue  # one of them is part of another token by now
            parts[k], parts[right] = a + b, None
            after[k] = after[right]
            if after[k] < n:
                before[after[k]] = k
            for left, at in ((before[k], k), (k, after[k])):
                if left >= 0 and at < n and (rank := ranks.get((parts[left], parts[at]))) is not None:
                    heapq.heappush(heap, (rank, left, parts[left], parts[at]))
        return [p for p in parts if p is not None]

    def encode_word(self, word: str) -> list[int]:
        return [self.ids[t] for t in self.merge(word)]

    def encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each word has, and the ids one after the other. A word is merged once for the array, or for
        several if it is kept."""
        coded, kept, found = words.dictionary_encode(), self._kept, []
        for word in coded.dictionary.to_pylist():
            ids = kept.get(word)
            if ids is None:
                ids = self.encode_word(word)
                if len(word) <= KEPT_LENGTH:
                    if len(kept) >= MOST_KEPT:
                        kept.clear()
                    kept[word] = ids
            found.append(ids)
        every = pa.array(found, pa.list_(pa.int32())).take(coded.indices)
        return np.diff(every.offsets.to_numpy()), every.flatten().to_numpy()

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become the replacement character, and special tokens are left out."""
        return b"".join(map(self._decoded.__getitem__, ids)).decode("utf-8", "replace")


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))


def word_table(found: DataFrame, word: str, vocabulary: Vocabulary) -> DataFrame:
    """(word, ids) of the distinct words of a column."""
    spark = found.sparkSession
    ship_code(spark)
    held = spark.sparkContext.broadcast(vocabulary)

    def run(batches):
        encode = held.value.encode_word
        for batch in batches:
            texts = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([encode(w) for w in texts], pa.list_(pa.int32()))], names=["word", "ids"])

    return found.select(F.col(word).alias("word")).filter("word IS NOT NULL").distinct().mapInArrow(run, "word string, ids array<int>")


def encoded(rows: DataFrame, texts: dict[str, str], vocabulary: Vocabulary, *key: str) -> DataFrame:
    """rows with the ids of several texts: texts names the column of ids for each column of text.

    Each row is encoded where it is, so nothing is shuffled, and the key is not looked at. Spark cuts the words, workers
    merge them. A null or empty text has no ids.
    """
    ship_code(rows.sparkSession)
    held = rows.sparkSession.sparkContext.broadcast(vocabulary)
    kept = [c for c in rows.columns if c not in texts.values()]
    names, cut = [*kept, *texts.values()], [f"_words{k}" for k in range(len(texts))]

    def column(found: pa.ListArray) -> pa.Array:
        ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(found), 0).to_numpy(zero_copy_only=False), dtype=np.int64)])
        sizes, ids = held.value.encode_words(found.flatten())
        upto = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        return pa.ListArray.from_arrays(pa.array(upto[ends], pa.int32()), pa.array(ids, pa.int32()))

    def pieces(batch: pa.RecordBatch, left: list[str]):
        if not left:
            yield batch
        for part in parts(batch, left[0], PART_VALUES) if left else ():
            yield from pieces(part, left[1:])

    def run(batches):
        for batch in batches:
            for part in pieces(batch, cut):
                yield pa.RecordBatch.from_arrays([*map(part.column, kept), *(column(part.column(name)) for name in cut)], names=names)

    schema = StructType(rows.select(*kept).schema.fields)
    for name in texts.values():
        schema = schema.add(name, ArrayType(IntegerType()))
    return rows.select(*kept, *(words(F.col(text)).alias(name) for text, name in zip(texts, cut))).mapInArrow(run, schema)


def decoded(rows: DataFrame, ids: str, name: str, vocabulary: Vocabulary) -> DataFrame:
    """Adds the text of a column of ids; null ids stay null."""
    spark = rows.sparkSession
    ship_code(spark)
    held = spark.sparkContext.broadcast(vocabulary)

    def run(batches):
        decode = held.value.decode
        for batch in batches:
            for part in parts(batch, ids, PART_VALUES):
                texts = [None if x is None else decode(x) for x in part.column(ids).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, name])

    return rows.mapInArrow(run, StructType([*rows.schema, *StructType().add(name, "string")]))


def token_counts(rows: DataFrame, text: str, vocabulary: Vocabulary, *key: str) -> DataFrame:
    """(key, tokens): how many ids each text has. Counts travel instead of ids; a text without any is not there."""
    pieces = rows.select(*key, F.explode(words(F.col(text))).alias("word"))
    counted = pieces.groupBy(*key, "word").agg(F.count("*").alias("_n"))
    sizes = word_table(counted, "word", vocabulary).select("word", F.size("ids").alias("_size"))
    return counted.join(sizes, "word").groupBy(*key).agg(F.sum(F.col("_n") * F.col("_size")).alias("tokens"))


def fragmented_words(counts: DataFrame, vocabulary: Vocabulary, least: int, min_length: int, most: int) -> DataFrame:
    """(token, place): frequent long words that take several tokens, with their capitalised form, in order of frequency,
    the first ``most`` distinct ones of twice as many. counts: rows (word, n, first_doc)."""
    wanted = counts.filter((F.col("n") >= least) & (F.length("word") >= min_length))
    several = word_table(wanted, "word", vocabulary).filter(F.size("ids") > 1).select("word")
    return placed_forms(wanted.join(several, "word", "left_semi"), most)


def new_tokens(candidates: DataFrame, token: str, rank: str, vocabulary: Vocabulary) -> DataFrame:
    """(token, id): candidates that the vocabulary has not, each once, numbered behind its last id in order of rank.

    A token counts as known in printable characters for its bytes, as the vocabulary has it, or as plain text. One
    row for each added token passes through a single task, as in the vocabulary's file.
    """
    spark = candidates.sparkSession
    known = spark.createDataFrame([(t,) for t in {*vocabulary.ids, *vocabulary.specials, *(bytes(vocabulary._bytes[c] for c in t).decode("utf-8", "ignore") for t in vocabulary.ids)}], f"{token} string")
    first = candidates.groupBy(token).agg(F.min(rank).alias(rank)).join(known, token, "left_anti")
    base = max([*vocabulary.ids.values(), *vocabulary.specials.values()]) + 1
    place = F.row_number().over(Window.orderBy(rank, token))
    return first.select(token, (place - 1 + base).cast("int").alias("id"))
