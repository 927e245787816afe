"""Hard negatives against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from lexiforge.llm import negatives

VECTORS = "vec_id long, embedding array<float>, label int, id string, score int, place int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, label, "clash", 1, 2) for i, v, label in rows], VECTORS).repartition(3)


def brute(rows, is_anchor, k=5, m=3):
    import math

    kept = [(i, label, [math.floor(256 * float(x)) for x in v]) for i, v, label in rows if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, label, v in kept:
        if not is_anchor(a):
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, other) for i, other, w in kept if i != a and len(w) == len(v))
        same = [(i, -s) for s, i, other in scored if other == label][:k]
        for p, ps in same:
            fit = [(i, -s) for s, i, other in scored if other != label and 50 * ps <= -100 * s <= 95 * ps][:m]
            out += [(a, p, r, i, ps, s) for r, (i, s) in enumerate(fit, 1)]
    return sorted(out)


def mined(spark, rows, every=5):
    found = negatives.mine(negatives.quantised(table(spark, rows)), F.col("id") % every == 0)
    return sorted(tuple(r) for r in found.collect())


def test_equals_brute_force_with_ties_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(negatives, "SHARD_ROWS", 40)
    monkeypatch.setattr(negatives, "BLOCK", 7)
    monkeypatch.setattr(negatives, "BLOCKS_A_TASK", 2)
    rnd = random.Random(3)
    draw = lambda: [rnd.randrange(-3, 4) / 4 for _ in range(4)]  # noqa: E731  few values, so many ties
    rows = [(i, draw(), 0 if i % 3 == 0 else rnd.randrange(4)) for i in range(-20, 150)]
    rows += [(200, None, 1), (205, draw(), None), (None, draw(), 1), (210, [float("nan")] * 4, 1), (215, [1.0, None, 0.0, 0.0], 1), (220, [float("inf")] * 4, 2), (225, [], 1), (230, [1.0, 2.0], 1), (235, [0.5, 2.0], 2), (240, [0.7, 2.0], 1)]
    got = mined(spark, rows)
    assert got == brute(rows, lambda i: i % 5 == 0) and len(got) > 100
    assert any(r[4] <= 0 for r in got) or all(r[4] > 0 for r in got)


def test_repeated_rows_count_as_often_as_they_occur(spark):
    rows = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (1, [1.0, 0.1], 1), (1, [1.0, 0.1], 1), (2, [0.9, 0.0], 2), (2, [0.9, 0.0], 2), (3, [0.8, 0.0], 2)]
    got = mined(spark, rows)
    assert got == brute(rows, lambda i: i % 5 == 0) and len(got) == 2 * 2 * 3


def test_empty_table_and_one_label(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(i, [1.0, float(i)], 1) for i in range(12)]) == []


def test_large_components_are_exact_or_an_error(spark):
    rows = [(0, [4000000.25, 1.0], 1), (1, [4000000.5, 3.0], 1), (2, [3000000.25, 2.0], 2), (3, [2500000.0, 2.0], 2)]
    assert mined(spark, rows) == brute(rows, lambda i: i % 5 == 0) != []
    with pytest.raises(Exception, match="32 bits"):
        mined(spark, [(0, [1e9, 1.0], 1), (1, [1.0, 1.0], 1)])
