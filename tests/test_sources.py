"""Crawls with damaged files, logs of batches, counts of one pass, quotas in rounds, and small readers."""

import gzip
import json
import random
import threading

import pytest
import zstandard
from pyspark.sql import functions as F

from lexiforge.operators import sampling, statistics
from lexiforge.sources import ledger, readers, writers


def test_ledger_of_whole_and_cut_files(spark, tmp_path):
    rnd = random.Random(1)
    texts = [json.dumps({"t": "".join(rnd.choices("abcdefgh é", k=200))}) for _ in range(3000)]
    contents = ("\n".join(texts[:10]) + "\n\n  \n" + "\n".join(texts[10:]) + "\n").encode()
    folder = tmp_path / "crawl" / "deep"
    folder.mkdir(parents=True)
    packed = {"a.jsonl": contents, "b.jsonl.gz": gzip.compress(contents), "c.jsonl.zst": zstandard.compress(contents), "two.jsonl.gz": gzip.compress(contents[:500]) + gzip.compress(contents[500:])}
    for name, raw in packed.items():
        (folder / name).write_bytes(raw)
    for name in ("b.jsonl.gz", "c.jsonl.zst"):
        (folder / f"cut-{name}").write_bytes(packed[name][: len(packed[name]) * 2 // 3])
    (folder / "no.jsonl.gz").write_bytes(b"this is no such file")
    (folder / "empty.jsonl").write_bytes(b"")
    (folder / "last.jsonl").write_bytes(b'{"t":1}\n{"t":2}')
    (folder / "other.txt").write_bytes(b"x")
    found = ledger.crawl_lines(spark, str(tmp_path / "crawl"))
    lines = {}
    for r in ledger.lines(found).orderBy("file", "line_no").collect():
        lines.setdefault(r.file.rsplit("/", 1)[1], []).append(r.line)
    account = {r.file.rsplit("/", 1)[1]: r for r in ledger.ledger(found).collect()}
    assert set(account) == {*packed, "cut-b.jsonl.gz", "cut-c.jsonl.zst", "no.jsonl.gz", "empty.jsonl", "last.jsonl"}
    for name in packed:
        assert lines[name] == texts and account[name].error is None and (account[name].lines, account[name].kept) == (3002, 3000)
    for name in ("cut-b.jsonl.gz", "cut-c.jsonl.zst"):
        got = lines.get(name, [])
        assert got == texts[: len(got)] and account[name].kept == len(got) and account[name].error
    assert len(lines["cut-b.jsonl.gz"]) > 500
    assert "no.jsonl.gz" not in lines and account["no.jsonl.gz"].error and account["empty.jsonl"].lines == 0
    assert lines["last.jsonl"] == ['{"t":1}', '{"t":2}']


def test_objects_beside_other_columns(spark):
    rows = spark.createDataFrame([(1, '{"a":1} {"a":2}'), (2, '{"a":3}{bad'), (3, "[1]"), (4, None), (5, " ")], "id long, line string")
    got = [(r.id, r.place, r.object, r.ok) for r in readers.objects_of(rows).collect()]
    assert sorted(got) == [(1, 0, '{"a": 1}', True), (1, 1, '{"a": 2}', True), (2, 0, '{"a": 3}', True), (2, 1, "{bad", False), (3, 0, "[1]", False)]


def test_small_files(spark, tmp_path):
    rows = spark.createDataFrame([("a,b", 'say "x"', None), ("é", "", "2")], "x string, y string, z string")
    writers.write_csv(rows.coalesce(1), str(tmp_path / "c"))
    back = readers.csv_rows(spark, str(tmp_path / "c"))
    assert back.columns == ["x", "y", "z"] and sorted((r.x, r.y or "", r.z) for r in back.collect()) == [("a,b", 'say "x"', None), ("é", "", "2")]
    (tmp_path / "t.txt").write_text("l'\n\n  d' \n")
    assert [r.token for r in readers.token_list(spark, str(tmp_path / "t.txt")).collect()] == ["l'", "d'"]


def test_counts_come_from_the_pass_that_writes(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    rows = spark.range(100).mapInPandas(count, "id long")
    about = json.loads(writers.write_counted(rows, str(tmp_path / "o"), {"even": F.col("id") % 2 == 0, "none": F.col("id") < 0}, seed=42, expected=100))
    assert about == {"counts": {"even": 50, "none": 0}, "total": 100, "seed": 42} and read.value == 100
    assert spark.read.parquet(str(tmp_path / "o")).count() == 100
    with pytest.raises(ValueError, match="100 rows, expected 99"):
        writers.write_counted(rows, str(tmp_path / "p"), {}, expected=99)
    assert json.loads(writers.write_counted(rows.limit(0), str(tmp_path / "q"), {"even": F.col("id") % 2 == 0}))["total"] == 0


def test_batches_of_a_log(spark, tmp_path):
    log = str(tmp_path / "log")
    batch = lambda *rows: spark.createDataFrame(rows, "key string, text string")
    assert writers.append_batch(batch(("a", "1"), ("b", "2"), ("b", "1")), "key", log, 0) == 2
    assert writers.append_batch(batch(("b", "3"), ("c", "4")), "key", log, 1) == 1
    assert writers.append_batch(batch(("b", "3"), ("c", "4")), "key", log, 1) == 1  # again, after a stop
    assert writers.append_batch(batch(("a", "9")), "key", log, 2) == 0
    # two writers that do not see each other
    threads = [threading.Thread(target=writers.append_batch, args=(batch(("d", f"by {k}"), (f"own {k}", "x")), "key", log, k)) for k in (3, 4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    got = {r.key: r.text for r in writers.read_log(spark, log, "key").collect()}
    assert got == {"a": "1", "b": "1", "c": "4", "d": got["d"], "own 3": "x", "own 4": "x"} and got["d"] in ("by 3", "by 4")
    assert writers.read_log(spark, log, "key").count() == 6


def test_appending_computes_its_rows_once(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    log = str(tmp_path / "log")
    rows = spark.range(20).mapInPandas(count, "id long")
    assert writers.append_new(rows, "id", log) == 20 and read.value == 20
    assert writers.append_new(rows, "id", log) == 0 and read.value == 40 and spark.read.parquet(log).count() == 20


def test_counters_stop_at_the_cap(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice("ab"), i, rnd.choice([None, "", " ", "x ***", "u", "v", "w", *"klmnop"]), rnd.random() < 0.3) for i in range(400)] + [("c", 500, "only", True)]
    frame = spark.createDataFrame(rows, "source string, id long, text string, made boolean").repartition(4)
    checks = {"skipped_empty": F.col("text").isNull() | (F.trim("text") == ""), "filtered_unk": F.contains("text", F.lit("***"))}
    for cap in (1, 4, 9, 50, None):
        got = {r.source: r.asDict() for r in statistics.capped_report(frame, "source", checks, ["text"], "id", cap, F.col("made")).collect()}
        for source in "abc":
            expected = dict(loaded=0, skipped_empty=0, filtered_unk=0, duplicates_removed=0, kept=0, codeswitched_created=0)
            seen = set()
            for s, _, text, made in sorted(rows, key=lambda r: r[1]):
                if s != source or (cap is not None and expected["kept"] == cap):
                    continue
                expected["loaded"] += 1
                if text is None or not text.strip():
                    expected["skipped_empty"] += 1
                elif "***" in text:
                    expected["filtered_unk"] += 1
                elif text in seen:
                    expected["duplicates_removed"] += 1
                else:
                    seen.add(text)
                    expected["kept"] += 1
                    expected["codeswitched_created"] += made
            assert got[source] == {"source": source, **expected}, (cap, source)


def test_quotas_in_rounds_are_greedy(spark):
    rnd = random.Random(7)
    names = ["x", "y", "z"]
    table = {(c, k): [(100 * k + i, rnd.choice("abcdefgh"), rnd.choice([[], [], ["too long"]])) for i in range(rnd.choice([0, 5, 9]))] for c in names for k in (1, 2, 3)}
    table["x", 1] = [(100 + i, k, []) for i, k in enumerate("abab")]
    asked = []

    def candidates(category, k):
        asked.append((category, k))
        return spark.createDataFrame(table[category, k], "id long, key string, errors array<string>")

    accepted, rejected = sampling.quota_rounds(candidates, names, 3, ["key"], ["id"], rounds=3)
    good, bad, seen, calls = [], [], set(), []
    for c in names:
        n = 0
        for k in (1, 2, 3):
            calls.append((c, k))
            for i, key, errors in table[c, k]:
                if n == 3:
                    break
                if errors or key in seen:
                    bad.append((c, k, i, "; ".join(errors) or "duplicate minimal pair"))
                else:
                    n += 1
                    seen.add(key)
                    good.append((c, k, i, f"{c}_{n:03d}"))
            if n == 3 or not table[c, k]:
                break
    assert sorted((r.category, r["round"], r.id, r["item"]) for r in accepted.collect()) == sorted(good)
    assert sorted((r.category, r["round"], r.id, r.reason) for r in rejected.collect()) == sorted(bad)
    assert asked == calls


def test_files_are_read_in_blocks(spark, tmp_path):
    rnd = random.Random(11)
    lines = [" ".join(rnd.choices(["lo", "can", "è", "", "  "], k=rnd.randrange(8))) + rnd.choice(["", "\r"]) for _ in range(500)]
    (tmp_path / "l.txt").write_bytes("\n".join(lines).encode())
    sentences, content = [], []
    for k in range(300):
        words = [rnd.choice(["lo", "can", "manja", "_"]) for _ in range(rnd.randrange(5))]
        rows = [f"{i}\t{w}\tx" for i, w in enumerate(words, 1)] + rnd.choice([[], ["1-2\tdel\t_", "2.1\tz\t_"]])
        text = rnd.choice([None, f"Lo {k} can."])
        content += [*([f"# sent_id = {k}"]), *([f"# text = {text}"] if text else []), *rows, *([""] * rnd.choice([1, 1, 2, 3]))]
        said = text or " ".join(w for w in words if w != "_")
        if said:
            sentences.append(said)
    (tmp_path / "c.conllu").write_text("\n".join(content))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("700b", before):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            found = readers.numbered_lines(spark, str(tmp_path / "l.txt"))
            assert (found.rdd.getNumPartitions() > 5) == (size == "700b")
            assert [tuple(r) for r in found.orderBy("line_no").collect()] == list(enumerate(x.removesuffix("\r") for x in lines))
            kept = readers.numbered_lines(spark, str(tmp_path / "l.txt"), keep_blank=False)
            assert [tuple(r) for r in kept.orderBy("line_no").collect()] == list(enumerate(x.strip() for x in lines if x.strip()))
            assert [r.text for r in readers.conllu_sentences(spark, str(tmp_path / "c.conllu")).collect()] == sentences
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
