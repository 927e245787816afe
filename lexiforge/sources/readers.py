"""Readers: JSON lines under three error policies, line corpora, CoNLL-U, CSV, JSON maps, fallback chains."""

from __future__ import annotations

import json
import struct
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import exprs as X
from ..functions.storage import stored
from . import tensors


def raw_lines(spark: SparkSession, folder: str, pattern: str = "*.jsonl*", damaged: bool = False) -> DataFrame:
    """Non-blank lines of all matching files under a folder, plain or compressed (.gz, .zst), with their file.

    A damaged file is an error; with ``damaged`` it contributes what can be read of it, and Spark logs its name.
    Compressed files cannot be split, so what is read is dealt out before anything expensive.
    """
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("ignoreCorruptFiles", damaged)
    lines = reader.text(folder).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"))
    return lines.filter(X.strip("line") != "")


def json_rows(spark: SparkSession, paths, schema: str, policy: str = "drop", required: list[str] | None = None) -> DataFrame:
    """Rows of JSON lines. policy: drop malformed lines; keep them in _corrupt; or fail at the first one.

    Strings are stripped, null ones empty; rows whose required fields are empty go.
    """
    modes = {"drop": "DROPMALFORMED", "keep": "PERMISSIVE", "fail": "FAILFAST"}
    types = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    wanted = types.add("_corrupt", "string") if policy == "keep" else types
    rows = spark.read.schema(wanted).option("mode", modes[policy]).option("columnNameOfCorruptRecord", "_corrupt").json(paths)
    for f in types.fields:
        if f.dataType.simpleString() == "string" and f.name != "_corrupt":
            rows = rows.withColumn(f.name, F.coalesce(X.strip(F.col(f.name)), F.lit("")))
    for name in required or []:
        rows = rows.filter(F.col(name) != "")
    return rows


def strict_json_rows(spark: SparkSession, paths, schema: str) -> DataFrame:
    """Rows of JSON lines; a malformed line or an empty file is an error."""
    rows = json_rows(spark, paths, schema, "fail")
    if rows.isEmpty():
        raise ValueError(f"no rows in {paths}")
    return rows


def _placed_lines(spark: SparkSession, path: str, keep: Callable | None = None) -> DataFrame:
    """(file, _block, line_no, text): the lines of files with their numbers from 0, in which only those count that ``keep``
    holds for. Files are read in blocks by many tasks; blocks are counted, and numbered from the counts of those before.
    The lines are stored once."""
    reader = spark.read.option("lineSep", "\n").text(path)
    text = F.regexp_replace("value", r"\r$", "").alias("text")
    lines = reader.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), text)
    lines = lines if keep is None else lines.filter(keep(F.col("text")))
    # a block is read by one task from its start to its end, where these ids rise by one
    held = stored(lines.withColumn("_id", F.monotonically_increasing_id()))
    blocks = held.groupBy("file", "_block").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy("file").orderBy("_block")) - F.col("_n")
    starts = blocks.select("file", "_block", (before - F.col("_first")).alias("_shift"))  # a row for a block
    return held.join(F.broadcast(starts), ["file", "_block"]).select("file", "_block", (F.col("_id") + F.col("_shift")).alias("line_no"), "text")


def numbered_lines(spark: SparkSession, path: str, keep_blank: bool = True) -> DataFrame:
    """(line_no, text): lines with a stable number from 0 in their file, as line corpora are aligned by it; without blank
    ones, stripped, if not ``keep_blank``. Large files are read by many tasks."""
    if keep_blank:
        return _placed_lines(spark, path).select("line_no", "text")
    return _placed_lines(spark, path, lambda text: X.strip(text) != "").select("line_no", X.strip("text").alias("text"))


def split_objects(lines: DataFrame, column: str = "line") -> DataFrame:
    """Several JSON objects on one line become several rows (object, ok); what follows them and is no object is
    one row with ok false."""

    def run(batches: Iterator):
        import pandas as pd

        decoder = json.JSONDecoder()
        for batch in batches:
            found, good = [], []
            for line in batch[column]:
                at = 0
                while line is not None and at < len(line):
                    if line[at].isspace():
                        at += 1
                        continue
                    try:
                        value, end = decoder.raw_decode(line, at)
                    except ValueError:
                        found.append(line[at:])
                        good.append(False)
                        break
                    found.append(json.dumps(value, ensure_ascii=False))
                    good.append(isinstance(value, dict))
                    at = end
            yield pd.DataFrame({"object": pd.Series(found, dtype="object"), "ok": pd.Series(good, dtype="bool")})

    return lines.select(column).mapInPandas(run, "object string, ok boolean")


class _Objects:
    """Objects of a line, with their places from 0; what follows them and is no object is the last, with ok false."""

    def eval(self, line: str):
        if line is None:
            return
        decoder, at, place = json.JSONDecoder(), 0, 0
        while at < len(line):
            if line[at].isspace():
                at += 1
                continue
            try:
                value, end = decoder.raw_decode(line, at)
            except ValueError:
                yield place, line[at:], False
                return
            yield place, json.dumps(value, ensure_ascii=False), isinstance(value, dict)
            at, place = end, place + 1


#: Table function: line -> rows (place, object, ok).
json_objects = F.udtf(_Objects, returnType="place int, object string, ok boolean")


def objects_of(rows: DataFrame, column: str = "line") -> DataFrame:
    """rows with the JSON objects of a column beside their other columns: a lateral join, so a line with several
    objects is repeated, and one with none goes."""
    return rows.lateralJoin(json_objects(F.col(column).outer())).drop(column)


def conllu_sentences(spark: SparkSession, path: str) -> DataFrame:
    """(sentence_no, text) of CoNLL-U files, in order: the "# text =" comment, else the forms of the words (no ranges, no
    empty nodes). Blank lines end sentences; numbers rise, from 0 in each file. Large files are read by many tasks: blank
    lines are counted by block, so a sentence may lie in two blocks."""
    lines = _placed_lines(spark, path).withColumn("_blank", (X.strip("text") == "").cast("long"))
    counts = lines.groupBy("file", "_block").agg(F.sum("_blank").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("file").orderBy("_block")) - F.col("_n")
    starts = counts.select("file", "_block", before.alias("_before"))  # a row for a block
    within = F.sum("_blank").over(Window.partitionBy("file", "_block").orderBy("line_no"))
    placed = lines.withColumn("_within", within).join(F.broadcast(starts), ["file", "_block"]).filter("_blank = 0")
    sentences = placed.groupBy("file", (F.col("_before") + F.col("_within")).alias("sentence_no")).agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("_lines"))
    texts = F.transform("_lines", lambda line: line["text"])
    comment = F.get(F.filter(texts, lambda line: line.startswith("# text = ")), F.lit(0))
    rows = F.filter(texts, lambda r: r.rlike(r"^\d+\t") & ~r.rlike(r"^\d+\t_\t"))
    forms = F.array_join(F.transform(rows, lambda r: F.split(r, "\t")[1]), " ")
    said = X.none_if_empty(X.strip(F.substr(comment, F.lit(len("# text = ") + 1))))
    found = sentences.select("file", "sentence_no", F.coalesce(said, forms).alias("text")).filter("text <> ''")
    return found.orderBy("file", "sentence_no").select("sentence_no", "text")


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, all columns strings."""
    return spark.read.option("header", True).csv(path)


def json_map(spark: SparkSession, path: str, value_type: str = "array<array<string>>") -> DataFrame:
    """A file with one JSON object as rows (key, value)."""
    parsed = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,{value_type}>").alias("m"))
    return parsed.select(F.explode("m").alias("key", "value"))


def token_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(X.strip("value").alias("token")).filter("token <> ''")


def first_non_empty(loaders: list[tuple[str, Callable[[], DataFrame]]]) -> tuple[str, DataFrame]:
    """The first source that loads and has rows; an error that names all failures if none has."""
    failures = []
    for name, load in loaders:
        try:
            rows = load()
            if not rows.isEmpty():
                return name, rows
            failures.append(f"{name}: empty")
        except Exception as error:  # any failure of a source makes way for the next
            failures.append(f"{name}: {str(error).splitlines()[0] if str(error) else type(error).__name__}")
    raise RuntimeError("no source has rows: " + "; ".join(failures))


def named_paths(specs: list[str]) -> dict[str, str]:
    """NAME=PATH or PATH; a repeated name gets _2, _3 and so on."""
    out: dict[str, str] = {}
    for spec in specs:
        name, _, path = spec.rpartition("=")
        name = name or path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
        unique, k = name, 1
        while unique in out:
            k += 1
            unique = f"{name}_{k}"
        out[unique] = path
    return out


def target_texts(rows: DataFrame, source_type: str, fields: tuple[str, ...] = ("target_text", "text")) -> DataFrame:
    """(text, source_type): the first of the fields that a row has and that is not empty; rows without one go."""
    return rows.select(X.pick_first(rows.columns, list(fields)).alias("text"), F.lit(source_type).alias("source_type")).filter("text <> ''")


def categorised_texts(rows: DataFrame, default: str, category: str = "category", text: str = "text") -> DataFrame:
    """(text, category): an empty or missing category is the default; rows without a text go."""
    named = X.none_if_empty(X.strip(F.col(category))) if category in rows.columns else F.lit(None).cast("string")
    return rows.select(X.strip(F.col(text)).alias("text"), F.coalesce(named, F.lit(default)).alias("category")).filter("text <> ''")


def all_splits(splits: dict[str, DataFrame], wanted: str | None = None) -> DataFrame:
    """One split, or all of them one after the other with the name of each row's split; a column that a split
    lacks is null. An unknown split is an error that names the known ones."""
    if wanted is not None and wanted not in splits:
        raise ValueError(f"no split {wanted}: {', '.join(sorted(splits))}")
    out = None
    for name, rows in splits.items():
        if wanted in (None, name):
            rows = rows.withColumn("split", F.lit(name))
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    if out is None:
        raise ValueError("no splits")
    return out


def matching_paths(spark: SparkSession, folder: str, patterns: list[str]) -> list[str]:
    """Files of a folder that match, in the order of the patterns, then of their names; each file once."""
    jvm, found = spark._jvm, []
    for pattern in patterns:
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{pattern}")
        matches = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
        found += sorted(str(m.getPath()) for m in matches if m.isFile())
    return list(dict.fromkeys(found))


def files_with_names(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """JSON lines of several files, with the name of each row's file as source_file."""
    return spark.read.schema(schema).json(paths).withColumn("source_file", F.col("_metadata.file_name"))


def tensor_rows(spark: SparkSession, path: str) -> DataFrame:
    """(key, idx, value) of the tensors of safetensors files, flattened in row-major order.

    A file is a little-endian 64-bit header size, a JSON header of types, shapes and offsets, and the data. Here a file
    is one task's, read by Spark from any store, and must be below 2 GiB; ``tensors.sliced_tensors`` reads larger ones in
    slices. Files of pickled objects are not read, as reading them runs their code.
    """

    def run(batches: Iterator):
        import numpy as np
        import pandas as pd

        for batch in batches:
            for raw in batch["content"]:
                (size,) = struct.unpack_from("<Q", raw)
                for part in tensors.slices("", raw[8 : 8 + size], tensors.BATCH):
                    values = tensors.numbers(raw[part.begin : part.end], part.kind)
                    yield pd.DataFrame({"key": part.key, "idx": np.arange(part.idx, part.idx + len(values)), "value": values})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "key string, idx long, value double")
