"""Readers of special inputs, guards, hooks and tokenizer checks."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexiforge.functions import exprs as X
from lexiforge.operators import cleaning, evaluation, joins, sampling, sequences
from lexiforge.sources import readers, writers


def test_texts_with_fallbacks_and_defaults(spark):
    rows = spark.createDataFrame([(" a ", "b"), ("", "c"), (None, "nan"), (None, None)], "target_text string, text string")
    assert [tuple(r) for r in readers.target_texts(rows, "flores").collect()] == [("a", "flores"), ("c", "flores")]
    assert [r.text for r in readers.target_texts(rows.select("text"), "x").collect()] == ["b", "c"]
    named = spark.createDataFrame([("x", " t "), (" ", "u"), (None, "v"), ("y", " ")], "category string, text string")
    assert [tuple(r) for r in readers.categorised_texts(named, "stress").collect()] == [("t", "x"), ("u", "stress"), ("v", "stress")]
    assert [tuple(r) for r in readers.categorised_texts(named.select("text"), "stress").collect()][0] == ("t", "stress")


def test_all_splits(spark):
    splits = {"train": spark.createDataFrame([(1, "a")], "id int, text string"), "dev": spark.createDataFrame([(2,)], "id int")}
    assert [tuple(r) for r in readers.all_splits(splits).select("id", "text", "split").collect()] == [(1, "a", "train"), (2, None, "dev")]
    assert readers.all_splits(splits, "dev").count() == 1
    with pytest.raises(ValueError, match="dev, train"):
        readers.all_splits(splits, "test")
    with pytest.raises(ValueError):
        readers.all_splits({})


def test_paths_and_file_names(spark, tmp_path):
    for name in ("b.jsonl", "a.jsonl", "c.json", "d.txt"):
        (tmp_path / name).write_text('{"text":"%s"}\n' % name)
    found = readers.matching_paths(spark, str(tmp_path), ["*.json", "*.json*", "none*"])
    assert [p.rsplit("/", 1)[1] for p in found] == ["c.json", "a.jsonl", "b.jsonl"]
    assert {(r.text, r.source_file) for r in readers.files_with_names(spark, found, "text string").collect()} == {(n, n) for n in ("c.json", "a.jsonl", "b.jsonl")}


def test_tensors(spark, tmp_path):
    arrays = {"a": np.arange(6, dtype="<f4").reshape(2, 3) / 4, "b": np.array([1, -2], "<i8"), "c": np.array([1.5, -2], "<f2")}
    brain = (np.array([1.0, -2.5], np.float32).view(np.uint32) >> 16).astype("<u2")
    header, data = {"__metadata__": {"format": "pt"}}, b""
    for name, kind, values in [("a", "F32", arrays["a"]), ("b", "I64", arrays["b"]), ("c", "F16", arrays["c"]), ("d", "BF16", brain)]:
        header[name] = {"dtype": kind, "shape": list(values.shape), "data_offsets": [len(data), len(data) + values.nbytes]}
        data += values.tobytes()
    text = json.dumps(header).encode()
    (tmp_path / "w.safetensors").write_bytes(len(text).to_bytes(8, "little") + text + data)
    got = {}
    for r in readers.tensor_rows(spark, str(tmp_path / "w.safetensors")).orderBy("key", "idx").collect():
        got.setdefault(r.key, []).append(r.value)
    assert got == {"a": [0, 0.25, 0.5, 0.75, 1, 1.25], "b": [1, -2], "c": [1.5, -2], "d": [1, -2.5]}


def test_rewrite_keeps_a_backup(spark, tmp_path):
    path = str(tmp_path / "rows")
    write = lambda rows, p: rows.write.parquet(p)
    writers.rewrite(spark.range(3), path, write)
    backup = writers.rewrite(spark.read.parquet(path).selectExpr("id * 10 AS id"), path, write)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [0, 10, 20]
    assert sorted(r.id for r in spark.read.parquet(backup).collect()) == [0, 1, 2]


PAIR = "id string, category string, source string, correct string, incorrect string, phenomenon string, needs_manual_review boolean"


@pytest.mark.parametrize(("row", "fault"), [(("1", "c", "s", " ", "b", None, None), "no correct in pair 1"), (("1", "c", "s", "a ", " a", None, None), "identical sides in pair 1"), ((None, "c", "s", "a", "b", None, None), "no id in pair")])
def test_pairs_with_faults(spark, row, fault):
    with pytest.raises(Exception, match=fault):
        cleaning.checked_pairs(spark.createDataFrame([row], PAIR)).collect()


def test_checked_pairs(spark):
    rows = spark.createDataFrame([("1", "c", "s", "a", "b", " ", None), ("2", "c", "s", "", "", "p", True)], PAIR)
    got = cleaning.checked_pairs(rows, skip_review=True).collect()
    assert [(r.id, r.phenomenon, r.source_lang) for r in got] == [("1", "c", "fr")]
    with pytest.raises(ValueError, match="no source"):
        cleaning.checked_pairs(rows.drop("source"))


def test_format_guard_and_required_values(spark):
    rows = spark.createDataFrame([(0, " a "), (1, " ")], "row int, text string")
    assert cleaning.plain_texts(rows) is rows
    with pytest.raises(ValueError, match="labels"):
        cleaning.plain_texts(rows.withColumn("labels", F.array()))
    with pytest.raises(ValueError, match="no text"):
        cleaning.plain_texts(rows.drop("text"))
    assert rows.filter("row = 0").select(X.required("text", "row").alias("t")).first().t == "a"
    with pytest.raises(Exception, match="empty value in row 1"):
        rows.select(X.required("text", "row")).collect()
    assert spark.createDataFrame([(" a\r\nb ",)], "t string").select(X.line_key("t").alias("k")).first().k == "a\nb"


@pytest.mark.parametrize("selector", ["7", "nobody", "", None])
def test_unknown_experts(spark, selector):
    with pytest.raises(Exception, match="no expert"):
        spark.createDataFrame([(selector,)], "s string").select(X.expert_index("s", ["fr", "ca", "7b"])).collect()


def test_experts(spark):
    rows = spark.createDataFrame([("0",), ("ca",), ("CA",), (" 7b",)], "s string")
    assert [r.i for r in rows.select(X.expert_index("s", ["fr", "ca", "7b"]).alias("i")).collect()] == [0, 1, 1, 2]


def test_hooks(spark):
    rows = spark.createDataFrame([("le can",), (None,), ("the dog",)], "text string")
    predict = lambda texts: [("fr" if t.startswith("le") else "en", len(t) / 10) for t in texts]
    assert [tuple(r) for r in cleaning.with_language(rows, "text", predict).collect()] == [("le can", "fr", 0.6), (None, None, None), ("the dog", "en", 0.7)]
    doubled = cleaning.batched_map(rows, lambda b: pd.concat([b, b]), "text string")
    assert doubled.count() == 6 and cleaning.batched_filter(rows, lambda b: b["text"].notna()).count() == 2


def test_tokenizer_checks(spark):
    rows = spark.createDataFrame([("a", ["Ã", "x", "y"], "a"), ("b c", ["b", "c"], "b  c")], "text string, tokens array<string>, decoded string")
    got = [(r.fertility, r.high, r.mismatch, r.artefact) for r in sequences.tokenizer_checks(rows, "text").collect()]
    assert got == [(3.0, True, False, True), (1.0, False, True, False)]
    words = spark.createDataFrame([("l'aiga", ["l'", "aiga"]), ("can", ["can"]), ("ostal", ["os", "tal"]), ("d'a", ["d", "'", "a"])], "w string, tokens array<string>")
    assert tuple(sequences.fixed_words(words, "w").first()) == (2, 4)


def test_texts_of_tokens(spark):
    rows = spark.createDataFrame([([bytearray(b"a"), bytearray("é".encode()[:1]), bytearray("é".encode()[1:]), bytearray(b"x" * 30), bytearray(b"\n")],), (None,)], "t array<binary>")
    assert [r.x for r in rows.select(sequences.token_texts(F.col("t")).alias("x")).collect()] == [["'a'", "<byte>", "'é'", "'" + "x" * 22, "'\\n'"], None]


def test_binomial_p_of_large_counts(spark):
    rows = spark.createDataFrame([(3, 10), (5, 10), (0, 1), (0, 0), (49_000, 100_000), (500_000_300, 10**9)], "k long, n long")
    got = [r.p for r in rows.select(X.binomial_p("k", "n").alias("p")).collect()]
    assert np.allclose([x for x in got if x is not None], [0.34375, 1.0, 1.0, 2.58e-10, 0.98486], rtol=1e-2) and got[3] is None


def test_ranks_and_splits_of_groups(spark):
    rows = spark.createDataFrame([(i, None if i % 5 == 0 else "ab"[i % 2]) for i in range(500)], "id long, g string").repartition(3)
    ranked = sampling.ranked(rows, "g", 1, "id").collect()
    for g in (None, "a", "b"):
        assert sorted(r["rank"] for r in ranked if r.g == g) == list(range(1, 1 + sum(r.g == g for r in ranked)))


def test_all_pairs_have_a_bound(spark, monkeypatch):
    monkeypatch.setattr(joins, "MOST_PAIRED", 3)
    assert joins.ordered_pairs(spark.range(3).selectExpr("id", "cast(id AS string) AS n"), "n", "id").count() == 3
    with pytest.raises(ValueError):
        joins.ordered_pairs(spark.range(4).selectExpr("id", "cast(id AS string) AS n"), "n", "id")


def test_windows_score_each_token_once(spark):
    losses = spark.createDataFrame([(n, i, 1.0) for n in (1, 2, 8, 9, 10, 11, 30) for i in range(n)], "doc int, place int, nll double")
    got = evaluation.windowed_losses(losses, ["doc"], 2, 8).collect()
    windows = sequences.sliding_windows(spark.createDataFrame([(n,) for n in (1, 2, 8, 9, 10, 11, 30)], "doc int").withColumn("total", F.col("doc").cast("long")), "total", 2, 8)
    expected = {(r.doc, r.window): r.scored for r in windows.collect() if r.scored}
    assert {(r.doc, r.window): r.scored for r in got} == expected
