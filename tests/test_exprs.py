"""Expressions against Python's own str and re, on awkward strings."""

import math
import re

import pytest
from pyspark.sql import functions as F

from lexiforge.functions import exprs as X

STRINGS = ["", " ", "\t\n", " a ", "  a  b\r\nc ", "nan", " NaN ", "d’aquí l'òme", "SÈM", "😀 x", "a|b|c", "...", "Un. Dos; tres: quatre, cinc", "one, two ,three"]


def collect(spark, column, values=STRINGS):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[0] for r in frame.orderBy("i").select(column).collect()]


@pytest.mark.parametrize(
    ("column", "expected"),
    [
        (lambda: X.strip("x"), lambda s: s.strip()),
        (lambda: X.squash("x"), lambda s: re.sub(r"\s+", " ", s).strip()),
        (lambda: X.clean_str("x"), lambda s: "" if s.strip().lower() == "nan" else s.strip()),
        (lambda: X.word_count("x"), lambda s: len(s.split())),
        (lambda: X.capitalize("x"), lambda s: s[:1].upper() + s[1:].lower()),
        (lambda: X.apostrophes("x"), lambda s: s.count("'")),
        (lambda: X.straight_quotes("x"), lambda s: s.replace("’", "'")),
        (lambda: X.contains_any("x", [" b", "sèm"]), lambda s: any(n in f" {s.lower()} " for n in [" b", "sèm"])),
    ],
)
def test_like_python(spark, column, expected):
    assert collect(spark, column()) == [expected(s) for s in STRINGS]


def test_null_is_empty(spark):
    assert collect(spark, X.clean_str("x"), [None]) == [""]


def test_segments(spark):
    got = collect(spark, X.segments("x"), ["Un. Dos; tres: quatre, cinc", "one, two ,three", "plain"])
    assert got == [["Un.", "Dos;", "tres:", "quatre, cinc"], ["one", "two", "three"], ["plain"]]


def test_code_fence(spark):
    assert collect(spark, X.strip_code_fence("x"), ['```json\n{"a":1}\n```', '{"a":1}']) == ['{"a":1}', '{"a":1}']


def test_seeded_index_is_uniform_and_seed_sensitive(spark):
    frame = spark.range(3000).select(X.seeded_index(3, 1, "id").alias("a"), X.seeded_index(3, 2, "id").alias("b"))
    counts = [r["count"] for r in frame.groupBy("a").count().collect()]
    assert len(counts) == 3 and min(counts) > 900
    assert frame.filter("a <> b").count() > 1500


def test_binomial_and_wilson(spark):
    frame = spark.createDataFrame([(60, 74), (0, 5), (5, 10), (0, 0)], "k int, n int")
    rows = frame.select(X.binomial_p("k", "n").alias("p"), X.wilson("k", "n", False).alias("lo"), X.wilson("k", "n", True).alias("hi")).collect()
    for r, (k, n) in zip(rows, [(60, 74), (0, 5), (5, 10)]):
        chances = [math.comb(n, i) / 2**n for i in range(n + 1)]
        assert abs(r.p - min(1, sum(c for c in chances if c <= chances[k] + 1e-15))) < 1e-9
        assert r.lo <= k / n + 1e-12 and r.hi >= k / n - 1e-12
    assert rows[3].p is None and rows[3].lo is None


def test_router_logits(spark):
    frame = spark.createDataFrame([([1.0, 2.0, 2.0],)], "x array<double>")
    row = frame.select(
        X.softmax("x", 0.5).alias("s"), X.one_hot_max("x").alias("h"), X.route_logits("x", {0: 1.5}).alias("b"), X.route_logits("x", force=0, disabled=[2]).alias("f")
    ).first()
    total = math.exp(2) + 2 * math.exp(4)
    assert abs(row.s[0] - math.exp(2) / total) < 1e-12
    assert row.h == [0.0, 1.0, 0.0] and row.b[0] == 2.5 and row.f[0] > 9000 and row.f[2] < -9000


def test_small_helpers(spark):
    row = spark.range(1).select(
        X.shorten(F.lit("abcdefghijklmno")).alias("s"), X.slug(F.lit("A  b-C!")).alias("g"), X.unescape(F.lit(r"a\nb\tc")).alias("u"), X.aligned_size(F.lit(129)).alias("n"), X.is_close(F.lit(1.0), F.lit(1.0 + 1e-12)).alias("c")
    ).first()
    assert tuple(row) == ("abcdefghijk...", "a_b_c", "a\nb\tc", 192, True)
