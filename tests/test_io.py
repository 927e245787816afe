"""Readers, writers, streams and generation on small files."""

import gzip
import json

import pytest
import zstandard
from pyspark.sql import functions as F

from lexiforge.operators import generation
from lexiforge.sources import readers, writers
from lexiforge.streaming import streams


def test_raw_lines_of_all_codecs(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.jsonl").write_text('{"t":1}\n\n  \n{"t":2}\n')
    (tmp_path / "y.jsonl.gz").write_bytes(gzip.compress(b'{"t":3}\n'))
    (tmp_path / "z.jsonl.zst").write_bytes(zstandard.compress(b'{"t":4}\n'))
    (tmp_path / "other.txt").write_text("no")
    assert sorted(r.line for r in readers.raw_lines(spark, str(tmp_path)).collect()) == [f'{{"t":{i}}}' for i in (1, 2, 3, 4)]


def test_three_policies(spark, tmp_path):
    path = tmp_path / "d.jsonl"
    path.write_text('{"text":" a "}\n{"text":null}\n{broken\n{"text":""}\n')
    assert [r.text for r in readers.json_rows(spark, str(path), "text string", required=["text"]).collect()] == ["a"]
    kept = readers.json_rows(spark, str(path), "text string", "keep").collect()
    assert [r._corrupt for r in kept if r._corrupt] == ["{broken"]
    with pytest.raises(Exception):
        readers.strict_json_rows(spark, str(path), "text string").collect()


def test_objects_on_one_line(spark):
    lines = spark.createDataFrame([('{"a":1} {"a":2}',), ('{"a":3}{bad',), ("[1]",), (None,)], "line string")
    got = [(r.object, r.ok) for r in readers.split_objects(lines).collect()]
    assert sorted(got) == sorted([('{"a": 1}', True), ('{"a": 2}', True), ('{"a": 3}', True), ("{bad", False), ("[1]", False)])


def test_lines_and_conllu_and_maps(spark, tmp_path):
    (tmp_path / "l.txt").write_text("a\n\nb \n")
    assert [(r.line_no, r.text) for r in readers.numbered_lines(spark, str(tmp_path / "l.txt")).collect()] == [(0, "a"), (1, ""), (2, "b ")]
    assert [(r.line_no, r.text) for r in readers.numbered_lines(spark, str(tmp_path / "l.txt"), False).collect()] == [(0, "a"), (1, "b")]
    (tmp_path / "c.conllu").write_text("# text = Lo can.\n1\tLo\t_\n\n1-2\tdel\t_\n1\tde\t_\n2\tlo\t_\n2.1\tx\t_\n3\t_\t_\n")
    assert [r.text for r in readers.conllu_sentences(spark, str(tmp_path / "c.conllu")).collect()] == ["Lo can.", "de lo"]
    (tmp_path / "m.json").write_text('{"can": [["chien", "0.6"], ["gos", "0.4"]]}')
    assert [(r.key, r.value) for r in readers.json_map(spark, str(tmp_path / "m.json")).collect()] == [("can", [["chien", "0.6"], ["gos", "0.4"]])]
    assert readers.named_paths(["a=/x", "a=/y", "/z/b.txt"]) == {"a": "/x", "a_2": "/y", "b": "/z/b.txt"}


def test_fallback_chain(spark):
    def broken():
        raise OSError("offline")

    empty, full = spark.range(0), spark.range(2)
    assert readers.first_non_empty([("a", broken), ("b", lambda: empty), ("c", lambda: full)])[0] == "c"
    with pytest.raises(RuntimeError, match="offline"):
        readers.first_non_empty([("a", broken), ("b", lambda: empty)])


def test_writers_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, "é\nx", None), (0, "b", "s")], "n int, text string, scenario string")
    writers.write_json_rows(rows, str(tmp_path / "j"), 1, source="synth")
    got = [json.loads(x) for p in (tmp_path / "j").glob("part*") for x in p.read_text().splitlines()]
    assert {"n": 1, "text": "é\nx", "source": "synth"} in got
    writers.write_lines(rows, "text", "n", str(tmp_path / "t"))
    assert [r.value for r in spark.read.text(str(tmp_path / "t")).collect()] == ["b", "é x"]
    assert json.loads(writers.counts_metadata(rows, "n", seed=42)) == {"counts": {"0": 1, "1": 1}, "total": 2, "seed": 42}
    assert "-- \\\\" in writers.latex_table(rows, ["n", "scenario"])
    with pytest.raises(ValueError):
        writers.check_count(rows, 3)
    assert [writers.append_new(rows, "n", str(tmp_path / "log")) for _ in range(2)] == [2, 0]


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"t":"2024-01-01T00:00:00Z","text":"one two three four five"}\n{"t":"2024-01-01T00:00:01Z","text":"One two  three four five"}\n{"t":"2024-01-01T00:00:02Z","text":"short"}\n')
    stream = spark.readStream.schema("t timestamp, text string").json(str(tmp_path / "in"))
    stream = streams.first_within(streams.cleaned(stream), "t", "1 hour", "text")
    run = stream.writeStream.foreachBatch(streams.append_unseen("text", str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_generation_retries_and_batches(spark):
    calls, waits = [], []

    def client(prompt):
        calls.append(prompt)
        if len(calls) < 3:
            raise RuntimeError("429 overloaded" if len(calls) == 1 else "bad")
        return '["ok"]'

    assert generation.complete(client, "p", sleep=waits.append) == '["ok"]' and waits == [60.0, 4.0]
    assert generation.complete(lambda p: "not json", "p", attempts=2, sleep=waits.append) is None
    rows = spark.createDataFrame([(i, f"w{i}") for i in range(5)], "k int, v string")
    assert [r["values"] for r in generation.batches(rows, "k", "v", 2).orderBy("batch").collect()] == [["w0", "w1"], ["w2", "w3"], ["w4"]]
    done = generation.completions(rows, "k", "v", lambda: lambda p: json.dumps([{"a": p, "b": "x"}]))
    flat = generation.flattened(done, "completion", "a string, b string").orderBy("k").collect()
    assert [(r.k, r.a) for r in flat] == [(i, f"w{i}") for i in range(5)]


def test_catalogue_is_complete():
    import __spark_entry__ as entry

    queries, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(queries) and len(queries) > 80
    assert all(callable(q) for q in queries.values())
