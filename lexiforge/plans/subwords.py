"""Queries of byte-level subwords; SQL knows no byte-pair merges, so they are tested against the library of the file."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import sampling, sequences, statistics, subwords
from . import mixing
from .tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str):
    def register(f):
        QUERIES[name] = f
        return f

    return register


def vocabulary(name: str = "byte_bpe_50k.json") -> subwords.Vocabulary:
    import public_tokenizers

    return subwords.Vocabulary.load(public_tokenizers.path(name))


def _joined(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), " ")


@query("subword_ids")
def subword_ids(spark, d):
    """The first 128 ids of each document, how many it has, and whether they decode to its text."""
    held = vocabulary()
    docs = table(spark, d, "documents").select("doc_id", "lang", "text")
    found = subwords.decoded(subwords.encoded(docs, {"text": "ids"}, held, "doc_id"), "ids", "_again", held)
    cut = sequences.tokenized(found, "ids", lambda ids: ids, 128, "lang", {"fr": 0, "es": 1})
    return cut.select("doc_id", _joined("input_ids").alias("ids"), F.size("ids").alias("n_tokens"), (F.col("_again") == F.coalesce("text", F.lit(""))).alias("same"), "expert_target")


@query("subword_fertility")
def subword_fertility(spark, d):
    """By language: documents, tokens, words, mean fertility, and documents with more than two tokens a word."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "text")
    counted = docs.select("doc_id", "lang", X.word_count("text").alias("words")).join(subwords.token_counts(docs, "text", vocabulary(), "doc_id"), "doc_id", "left")
    tokens = F.coalesce("tokens", F.lit(0))
    value = tokens / F.greatest(F.lit(1), F.col("words"))
    return counted.groupBy("lang").agg(
        F.count("*").alias("n"), F.sum(tokens).alias("tokens"), F.sum("words").cast("long").alias("words"), F.round(F.avg(value), 6).alias("fertility"), F.count_if(value > 2.0).alias("n_high")
    )


@query("subword_candidates")
def subword_candidates(spark, d):
    """New tokens for a vocabulary: listed endings, then frequent words that take several tokens; with their ids."""
    held = vocabulary()
    counts = statistics.word_frequency(table(spark, d, "documents"), "text", "doc_id", r"[\p{L}]+")
    listed = spark.createDataFrame([("l'", 0), ("tion", 1), ("ció", 2), ("the", 3)], "token string, rank long")
    found = subwords.fragmented_words(counts, held, 5, 4, 300).select("token", (F.col("place") + 1000).alias("rank"))
    return subwords.new_tokens(listed.unionByName(found), "token", "rank", held)


@query("subword_batches")
def subword_batches(spark, d):
    """Replies as training rows of 64 ids: prompts masked, padded in batches of 8."""
    pairs = subwords.encoded(mixing._replies(spark, d), {"instruction": "asked", "output": "answered"}, vocabulary(), "conv_id", "turn")
    masked = sequences.masked_labels(pairs.select("conv_id", "turn", "asked", "answered"), "asked", "answered", lambda ids: ids, 64, 50256)
    placed, _ = sampling.numbered(masked.select("conv_id", "turn", "input_ids", "labels"), "k", "conv_id", "turn")
    batches = sequences.padded(placed, "k", 8, 0, 50_257)
    return batches.select("conv_id", "turn", F.col("batch").cast("long").alias("batch"), _joined("input_ids").alias("input_ids"), _joined("labels").alias("labels"))
