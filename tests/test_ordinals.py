"""Places in an order, and what is built on them: whole tables, in no single task."""

import random

import pytest
from pyspark.sql import functions as F

from lexiforge.functions.storage import stored
from lexiforge.operators import joins, sampling
from lexiforge.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["pad_clamp", "offset_slice", "seeded_shuffle", "parallel_align", "codeswitch", "ordered_batches", "pack_sequences"])
def test_no_single_task_holds_a_table(spark, name):
    plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "GlobalLimit" not in plan


def test_ranges_follow_the_input(spark, monkeypatch):
    monkeypatch.setattr(sampling, "RANGE_ROWS", 100)
    rnd = random.Random(6)
    keys = [(rnd.choice([None, 1, 2, 3]), i) for i in range(3000)]
    rows = spark.createDataFrame(keys, "a int, b long").repartition(5)
    placed, n = sampling.numbered(rows, "place", "a", "b")
    assert placed.rdd.getNumPartitions() > 20
    expected = sorted(keys, key=lambda k: (k[0] is not None, k[0] or 0, k[1]))
    assert n == 3000 and [(r.place, r.a, r.b) for r in placed.collect()] == [(k, *key) for k, key in enumerate(expected)]
    for skip in (0, 1, 1234, 2999, 3000, 5000):
        assert [(r.a, r.b) for r in sampling.offset(rows, skip, "a", "b").collect()] == expected[skip:]


def test_equal_keys_get_different_places(spark):
    rows = spark.createDataFrame([(1,)] * 500 + [(2,)] * 3, "a int").repartition(4)
    placed, _ = sampling.numbered(rows, "place", "a")
    assert [(r.place, r.a) for r in placed.orderBy("place").collect()] == [(k, 1 if k < 500 else 2) for k in range(503)]


def test_stored_rows_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(len(batch))
            yield batch

    rows = stored(spark.range(100).mapInPandas(count, "id long"))
    assert rows.count() == rows.filter("id >= 0").count() == 100 and made.value == 100


def test_code_switching_follows_its_target(spark):
    rnd = random.Random(1)
    rows = [(i, ("en", "fr", "de")[i % 3], " ".join(f"{w}{i}." for w in rnd.sample("abcdefgh", 4))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(4)
    pairs = [("en", "fr"), ("fr", "en"), ("en", "oc")]
    made = {}
    for target in (0, 7, 150):
        found = joins.code_switched(docs, "lang", "text", "doc_id", pairs, target, 42).collect()
        made[target] = sorted((r.attempt, r.anchor, r.donor, r.text) for r in found)
        assert len(found) == target and len({r.text for r in found}) == target
        for r in found:
            assert (r.anchor_lang, r.inserted_lang) in pairs[:2]
            parts = r.text.split(" ")
            inserted = parts.pop(r.insert_after_segment)
            assert " ".join(parts) == rows[r.anchor][2] and inserted in rows[r.donor][2].split(" ")
    # more attempts come behind those that are there already
    assert made[7] == made[150][:7]
    few = docs.filter(F.col("doc_id") < 6)
    assert 0 < joins.code_switched(few, "lang", "text", "doc_id", pairs, 400, 42).count() < 400
    assert joins.code_switched(docs.limit(0), "lang", "text", "doc_id", pairs, 5, 42).count() == 0
