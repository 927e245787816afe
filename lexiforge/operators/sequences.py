"""Sequence preparation: tokens, masks, padding, windows. Tokenizers are column expressions."""

from __future__ import annotations

import codecs
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import exprs as X
from ..functions.batches import parts
from ..functions.shipping import ship_code
from . import sampling

IGNORE = -100
Tokenizer = Callable[[Column], Column]


def hashed_words(vocab: int = 50_000) -> Tokenizer:
    """A stand-in tokenizer: each word's id is a hash of it, from 1 to ``vocab``."""
    return lambda text: F.transform(X.words(text), lambda w: (F.conv(F.substr(F.md5(w), F.lit(1), F.lit(8)), 16, 10).cast("long") % vocab + 1).cast("int"))


def tokenized(rows: DataFrame, text: str, tokenizer: Tokenizer, max_length: int, lang: str | None = None, targets: dict[str, int] | None = None) -> DataFrame:
    """Adds input_ids (cut at max_length) and, by language, expert_target (or the ignore label)."""
    out = rows.withColumn("input_ids", F.slice(tokenizer(F.col(text)), 1, max_length))
    if targets is not None:
        chosen = F.lit(IGNORE)
        for name, index in targets.items():
            chosen = F.when(F.col(lang) == name, index).otherwise(chosen)
        out = out.withColumn("expert_target", chosen)
    return out


def masked_labels(rows: DataFrame, prompt: str, output: str, tokenizer: Tokenizer, max_length: int, eos: int) -> DataFrame:
    """Adds input_ids and labels of prompt + output; the prompt is masked. Rows with nothing to learn go."""
    first = tokenizer(F.col(prompt))
    full = F.slice(F.concat(first, tokenizer(F.col(output))), 1, max_length)
    ids = F.when(F.size(full) < max_length, F.concat(full, F.array(F.lit(eos)))).otherwise(full)
    out = rows.withColumn("_prompt", F.least(F.size(first), F.size(full))).withColumn("input_ids", ids)
    labels = F.concat(F.array_repeat(F.lit(IGNORE), F.col("_prompt")), F.slice("input_ids", F.col("_prompt") + 1, F.size("input_ids")))
    return learnable(out.withColumn("labels", labels).drop("_prompt"))


def learnable(rows: DataFrame, labels: str = "labels") -> DataFrame:
    return rows.filter(F.exists(labels, lambda x: x != IGNORE))


def padded(rows: DataFrame, order: str, batch_size: int, pad: int, vocab: int) -> DataFrame:
    """Adds batch; pads ids and labels to the longest row of the batch, clamps labels to the vocabulary.

    ``order`` is a dense ordinal from 0, so batches need no ranking of the whole table.
    """
    batched = rows.withColumn("batch", F.floor(F.col(order) / batch_size))
    size = F.max(F.size("input_ids")).over(Window.partitionBy("batch"))

    def fill(c, value):
        return F.concat(c, F.array_repeat(F.lit(value), F.col("_size") - F.size(c)))

    clamped = F.transform("labels", lambda x: F.when(x == IGNORE, x).otherwise(F.least(F.greatest(x, F.lit(0)), F.lit(vocab - 1))))
    sized = batched.withColumn("_size", size)
    return sized.withColumn("labels", fill(clamped, IGNORE)).withColumn("input_ids", fill(F.col("input_ids"), pad)).drop("_size")


def sliding_windows(items: DataFrame, total: str, stride: int, length: int) -> DataFrame:
    """One row per evaluation window of each item: window, begin, end, scored.

    Windows begin at multiples of the stride and stop once one reaches the end. A window scores the tokens
    since the end of the window before; the first token of a window has no context, so a window that is
    all new scores one less.
    """
    k = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.greatest(F.col(total) - length, F.lit(0)) / stride), F.lit(0)).cast("long")))
    begun = items.filter(F.col(total) > 0).withColumn("window", k).withColumn("begin", F.col("window") * stride).filter(F.col("begin") < F.col(total))
    ended = begun.withColumn("end", F.least(F.col("begin") + length, F.col(total)))
    previous = F.when(F.col("window") == 0, 0).otherwise(F.least(F.col("begin") - stride + length, F.col(total)))
    target, chunk = F.col("end") - previous, F.col("end") - F.col("begin")
    return ended.withColumn("scored", F.when(target < chunk, target).otherwise(chunk - 1))


def packed(rows: DataFrame, group: str, order: str, size: str, capacity: int) -> DataFrame:
    """Adds sequence: consecutive rows of a group share one as their running size passes each multiple of capacity."""
    summed = sampling.running(rows, group, [order], {"_upto": F.col(size)})
    return summed.withColumn("sequence", F.floor((F.col("_upto") - F.col(size)) / capacity).cast("long")).drop("_upto")


def prefix_stream(lines: DataFrame, doc: str, line_no: str, text: str, prefix_size: int, separator_size: int) -> DataFrame:
    """Where each line's words lie in the stream prefix + line + separator of its document: begin, end."""
    size = X.word_count(text).cast("long")
    step = size + prefix_size + separator_size
    before = F.coalesce(F.sum(step).over(Window.partitionBy(doc).orderBy(line_no).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return lines.withColumn("begin", before + prefix_size).withColumn("end", F.col("begin") + size)


def fragments(word: Column, unit: int = 3) -> Column:
    """A toy subword count: pieces of ``unit`` characters."""
    return F.ceil(F.length(word) / unit).cast("long")


def fragmented_words(counts: DataFrame, least: int, min_length: int, most: int) -> DataFrame:
    """Frequent long words that take several pieces, with their capitalised form, in order of frequency."""
    wanted = counts.filter((F.col("n") >= least) & (F.length("word") >= min_length) & (fragments(F.col("word")) > 1))
    return placed_forms(wanted, most)


def placed_forms(wanted: DataFrame, most: int) -> DataFrame:
    """(token, place) of the first ``most`` words by frequency and of their capitalised forms, each once."""
    top = wanted.orderBy(F.desc("n"), "first_doc", "word").limit(most)
    place = F.row_number().over(Window.orderBy(F.desc("n"), "first_doc", "word"))  # over ``most`` rows
    both = top.withColumn("_p", place).select("_p", F.posexplode(F.array("word", X.capitalize("word"))).alias("_k", "token"))
    first = both.groupBy("token").agg(F.min(F.col("_p") * 2 + F.col("_k")).alias("place"))
    return first.orderBy("place").limit(most)


def byte_characters() -> list[str]:
    """A printable character for each byte: printing ones stand for themselves, the others follow from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in prints)}
    return [others.get(b, chr(b)) for b in range(256)]


def byte_level(text) -> Column:
    """The text's UTF-8 bytes as printable characters."""
    pairs = F.regexp_extract_all(F.hex(F.encode(X.col(text), "UTF-8")), F.lit(".."), F.lit(0))
    characters = F.array(*map(F.lit, byte_characters()))
    return F.array_join(F.transform(pairs, lambda h: F.get(characters, F.conv(h, 16, 10).cast("int"))), "")


def template_choice(rows: DataFrame, templates: list[str], key: str, seed, name: str = "instruction") -> DataFrame:
    chosen = F.get(F.array(*map(F.lit, templates)), X.seeded_index(len(templates), seed, key).cast("int"))
    return rows.withColumn(name, chosen)


def repeated(rows: DataFrame, group: str, times: dict[str, int], default: int = 1) -> DataFrame:
    """Each row as often as its group says (at least once), with a copy number."""
    k = F.lit(max(default, 1))
    for name, n in times.items():
        k = F.when(F.col(group) == name, max(n, 1)).otherwise(k)
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), k)))


def library_tokens(texts: DataFrame, text: str, path: str) -> DataFrame:
    """Adds tokens (as the tokenizer of the ``tokenizers`` file at ``path`` writes them) and decoded, the text of their ids.

    A worker encodes one text after the other and hands its rows on by about a megabyte of text: what the library holds
    for a text is some fifty times as large.
    """
    ship_code(texts.sparkSession)

    def run(batches):
        from tokenizers import Tokenizer

        tool = Tokenizer.from_file(path)
        for batch in batches:
            for part in parts(batch, text):
                tokens, decoded = [pa.array([], pa.string())], []
                for t in part.column(text):
                    found = tool.encode(t.as_py() or "", add_special_tokens=False)
                    tokens.append(pa.array(found.tokens, pa.string()))
                    decoded.append(tool.decode(found.ids, skip_special_tokens=False))
                ends = np.cumsum([len(x) for x in tokens], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays(tokens))
                yield pa.RecordBatch.from_arrays([*part.columns, lists, pa.array(decoded, pa.string())], names=[*part.schema.names, "tokens", "decoded"])

    return texts.mapInArrow(run, StructType([*texts.schema, *StructType.fromDDL("tokens array<string>, decoded string")]))


def tokenizer_checks(rows: DataFrame, text: str) -> DataFrame:
    """Adds what is looked at in a tokenizer: fertility (tokens a word), high (above 2), mismatch (the decoded text
    differs from the text), artefact (a token shows bytes of other characters)."""
    fertility = F.size("tokens") / F.greatest(F.lit(1), X.word_count(text))
    artefact = F.exists("tokens", lambda t: t.contains("Ã") | t.contains("â"))
    return rows.withColumn("fertility", fertility).withColumn("high", fertility > 2.0).withColumn("mismatch", F.col("decoded") != F.coalesce(F.col(text), F.lit(""))).withColumn("artefact", artefact)


def fixed_words(rows: DataFrame, word: str) -> DataFrame:
    """(fixed, total): words that are one token, or two at most if they have an apostrophe."""
    most = F.when(F.col(word).rlike("['’]"), 2).otherwise(1)
    return rows.agg(F.count_if(F.size("tokens") <= most).alias("fixed"), F.count("*").alias("total"))


def token_texts(tokens: Column) -> Column:
    """What each token (a binary) adds to the decoded text, as Python writes a string, cut at 23 characters; a token
    after which a character is still incomplete is <byte>."""

    @F.pandas_udf("array<string>")
    def decoded(column: pd.Series) -> pd.Series:
        def one(items):
            if items is None:
                return None
            decoder = codecs.getincrementaldecoder("utf-8")("replace")
            texts = [decoder.decode(bytes(t)) for t in items]
            return ["<byte>" if not x and len(t) else repr(x)[:23] for x, t in zip(texts, items)]

        return column.map(one)

    return decoded(tokens)
