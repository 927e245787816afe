"""A corpus pipeline over documents: language, near duplicates, repeated passages, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before kept. Stages but the last
return the columns of documents, whatever those are besides doc_id, text, lang and n_chars.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.llm import jaccard, langid, packing, passages
from lexiforge.llm.common import Scratch, opened, ship_code


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents in no language: null texts, and texts without a letter. A missing lang is filled in.

    The model learns from a bounded sample of the labelled documents and only fills in what is missing; its
    scores reject nothing, so junk of letters in no learned language stays. If none is labelled, there is
    nothing to learn, and the same texts go. Whole texts are read, however long; of languages that score alike the
    first by name fills in; repeated rows are treated alike; an empty table stays empty; columns may have any names.
    """
    model = langid.train(docs)
    if model is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    renamed = docs.select(*(F.col(c).alias(f"c{i}_{'text' if c == 'text' else ''}") for i, c in enumerate(docs.columns)))
    text = f"c{docs.columns.index('text')}_text"
    found = langid.identify(renamed, model, text_col=text).filter(F.col("lang_pred") != langid.UNDETERMINED)
    columns = [F.col(n).alias(c) if c != "lang" else F.coalesce(F.col(n), "lang_pred").alias(c) for n, c in zip(renamed.columns, docs.columns)]
    return found.select(*columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: the first row. Texts without words stay.

    Rows are told apart by their place in the stored table, so repeated ids and null ids do no harm.
    """
    row = "row_of_document"
    while row in docs.columns:
        row += "_"
    placed = docs.withColumn(row, F.monotonically_increasing_id())
    groups = jaccard.near_duplicates(placed.select(F.col(row).alias("doc_id"), "text"))
    stays = groups.filter("doc_id = component_id").select(F.col("doc_id").alias(row))
    return placed.join(stays, row, "left_semi").drop(row)


def _whole_characters(kept: pd.Series) -> pd.Series:
    """Text of bytes; what a cut left of a character goes."""
    return kept.map(lambda b: None if b is None else bytes(b).decode("utf-8", "ignore"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out every byte that a string of 200 bytes covers which occurs elsewhere too. All documents stay."""
    ship_code(spark)
    names = [f"c{i}" for i in range(len(docs.columns))]
    text = names[docs.columns.index("text")]
    found = passages.remove_repeats(docs.toDF(*names), text_col=text)
    whole_characters = F.pandas_udf(_whole_characters, "string")
    found = found.withColumn(text, F.when(F.col("n_removed") == 0, F.col("kept").cast("string")).otherwise(whole_characters("kept")))
    columns = [F.col(n).alias(c) if c != "n_chars" else F.length(text).cast("long").alias(c) for n, c in zip(names, docs.columns)]
    return found.select(*columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of token ids, ready for training: a row for each piece of a document. Null texts count as empty,
    and null ids stay null; very long texts are cut into full sequences and a rest; repeated rows are packed as
    often as they occur; an empty table gives no rows; other columns are not looked at."""
    packed = packing.pack_documents(docs)
    return packed.withColumnRenamed("id", "doc_id")


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("packing", pack),
]

#: None of the stages can be expressed in SQL: each is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn. Each result is a table in the shared folder; once it is written, the one before it and
    what the stage's operator has stored on the way are deleted."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        first = len(opened)
        docs = scratch.store(stage(spark, docs, sf_dir), name)
        for other in opened[first:]:
            other.close()
        if before is not None:
            scratch.drop(before)
        before = docs
    return docs
