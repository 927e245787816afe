"""Token counts by section, from one encoding of the whole document.

A document is encoded once; each token knows its character span; sections are intervals of characters.
An interval join inside the row gives every token to sections by an explicit rule:

* ``start``: to the section that holds its first character,
* ``most``: to the section that holds most of its characters (the earlier one of equals),
* ``share``: to all sections that it touches, in proportion to its characters in each.

Token counts are sums, so counts of sections add up to those of the document under each rule.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import ship_code

RULES = ("start", "most", "share")


def token_spans(text: str, encoder: bpe.Encoder) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, starts, ends) of the tokens, in characters; a token of a part of a character spans that character."""
    ids = np.frombuffer(encoder.encode(text), "<u4")
    raw = text.encode("utf-8", "surrogatepass")
    ends = np.cumsum(encoder.byte_lengths[ids])
    if len(ids) and ends[-1] != len(raw):
        raise ValueError("the tokens do not spell the text")
    starts = ends - encoder.byte_lengths[ids]
    if len(raw) == len(text):
        return ids, starts, ends
    leads = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
    character = np.cumsum(leads) - 1  # the character of each byte
    return ids, character[starts], character[ends - 1] + 1


def line_sections(text: str) -> np.ndarray:
    """Bounds of the lines, each with its line feed: 0, ..., len(text)."""
    bounds = [0]
    at = text.find("\n")
    while at >= 0:
        bounds.append(at + 1)
        at = text.find("\n", at + 1)
    if bounds[-1] != len(text):
        bounds.append(len(text))
    return np.array(bounds, np.int64)


def attribute(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, crossing) of each section between neighbouring bounds, which cover all spans without gaps.

    crossing counts tokens that touch the section and another one.
    """
    n = len(bounds) - 1
    first = np.searchsorted(bounds, starts, side="right") - 1
    last = np.searchsorted(bounds, ends, side="left") - 1
    single = first == last
    tokens = np.bincount(first[single], minlength=n).astype(float)
    crossing = np.zeros(n, np.int64)
    for a, b, lo, hi in zip(starts[~single], ends[~single], first[~single], last[~single]):
        within = np.minimum(bounds[lo + 1 : hi + 2], b) - np.maximum(bounds[lo : hi + 1], a)
        crossing[lo : hi + 1] += within > 0
        if rule == "start":
            tokens[lo] += 1
        elif rule == "most":
            tokens[lo + int(within.argmax())] += 1
        else:
            tokens[lo : hi + 1] += within / (b - a)
    return tokens, crossing


def count_tokens(docs: DataFrame, fields: list[str], id_col: str = "doc_id", rule: str = "most", sections: str = "fields", tokenizer_path: str | None = None) -> DataFrame:
    """Token counts of parts of each row: id, field, section, start, end, n_tokens, n_crossing.

    The fields are joined by line feeds and encoded once, as one document. With sections "fields", a part is
    a field (with the line feed after it); with "lines", a line of a field. section counts the parts of
    the row from 0; start and end are characters of the joined document. Null fields count as empty; an
    empty part has no tokens and keeps its row. A row whose fields are all empty and need no line feed
    gives one empty part. Rows are independent, repeated ones repeat their result, and an empty table
    gives none. Null ids stay null; very long texts are encoded whole; of sections that hold as much of a token
    the earlier one gets it. Columns not named are not looked at.
    """
    if rule not in RULES or sections not in ("fields", "lines"):
        raise ValueError("rule or sections")
    ship_code(docs.sparkSession)
    path = tokenizer_path or bpe.vocabulary_path()

    def run(batches):
        encoder = bpe.encoder(path)
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                values = [v if isinstance(v, str) else "" for v in row[1:]]
                text = "\n".join(values)
                _, starts, ends = token_spans(text, encoder)
                bounds, names, at = [0], [], 0
                for k, (name, value) in enumerate(zip(fields, values)):
                    size = len(value) + (k + 1 < len(values))
                    inner = line_sections(text[at : at + size])[1:] + at if sections == "lines" and size else [at + size]
                    bounds.extend(inner)
                    names += [name] * len(inner)
                    at += size
                bounds = np.array(bounds, np.int64)
                held = np.concatenate([[True], bounds[1:] > bounds[:-1]])  # empty parts hold no token
                tokens, crossing = np.zeros(len(names)), np.zeros(len(names), np.int64)
                if held[1:].any():
                    tokens[held[1:]], crossing[held[1:]] = attribute(starts, ends, bounds[held], rule)
                out += [(row[0], name, k, int(bounds[k]), int(bounds[k + 1]), float(tokens[k]), int(crossing[k])) for k, name in enumerate(names)]
            yield pd.DataFrame(out, columns=["id", "field", "section", "start", "end", "n_tokens", "n_crossing"])

    narrow = docs.select(F.col(id_col).cast("long").alias("id"), *(F.col(f).cast("string").alias(f"field_{k}") for k, f in enumerate(fields)))
    return narrow.mapInPandas(run, "id long, field string, section int, start long, end long, n_tokens double, n_crossing long")


def query(spark, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document, and of its source and language, in one encoding."""
    found = count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["source", "lang", "text"], sections="lines")
    return found.withColumnRenamed("id", "doc_id")
