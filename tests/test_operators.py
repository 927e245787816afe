"""Operators on small literal tables."""

import pytest
from pyspark.sql import functions as F

from lexiforge.operators import cleaning, dedup, evaluation, joins, routing, sampling, sequences, vectors


def test_clean_lines_uses_unicode_and_order(spark):
    text = "Aquesta es una linha que demòra aquí [ Modificar la seccion ]\ncorta\nclicar sul ligam per vos inscriure ara mesme\n  Una autra linha pro longa per demorar  "
    frame = spark.createDataFrame([(1, text), (2, "tot cort"), (3, None)], "id int, text string")
    rows = cleaning.clean_documents(frame).collect()
    assert [(r.id, r.text) for r in rows] == [(1, "Aquesta es una linha que demòra aquí\nUna autra linha pro longa per demorar")]


@pytest.mark.parametrize(
    ("text", "rejects", "keep"),
    [
        ("Lo can manja", [], True),
        ("eth can manja lo pan", ["gascon_articles_eth_era"], False),
        ("bèlo çal vesèes", [], True),
        ("Que soi content", ["gascon_enunciative_que_initial"], False),
        ("rien du tout", [], False),
    ],
)
def test_dialect_rules(spark, text, rejects, keep):
    frame = spark.createDataFrame([(text,)], "text string")
    row = cleaning.rule_scores(frame, "text", cleaning.REJECT_RULES, cleaning.POSITIVE_RULES).first()
    assert (row.rejects, row.keep) == (rejects, keep)


def test_pair_errors_in_order(spark):
    rows = [
        ("articles", "Le chien", "Lo can dormís", "El can dormís", "x"),
        ("articles", "Le chien", "Aqueste can", "El can", ""),
        ("elision", "D'ici", "d’aquí", "de aquí", "x"),
        ("agreement", "a", "Meteis", "meteis", "x"),
        ("other", "a", "b", "c", "d"),
    ]
    frame = spark.createDataFrame(rows, "category string, source string, correct string, incorrect string, explanation string")
    got = [r.errors for r in cleaning.validated_pairs(frame).collect()]
    assert got == [
        [],
        ["missing explanation", "correct_oc lacks required category marker"],
        [],
        ["correct_oc and incorrect_oc are identical"],
        ["unknown category"],
    ]


def test_first_wins_and_chain(spark):
    frame = spark.createDataFrame([(1, "A  b"), (2, "a b"), (3, "c"), (4, None), (5, None)], "i int, t string")
    assert sorted(r.i for r in dedup.first_wins(frame, [dedup.text_key("t")], ["i"]).collect()) == [1, 3, 4]
    one = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "i int, t string")
    two = spark.createDataFrame([(4, "z"), (5, "x"), (6, "w")], "i int, t string")
    # z was beyond the cap of the first source, so the second may bring it
    assert sorted(r.i for r in dedup.capped_chain([(one, 2), (two, None)], "t", "i").collect()) == [1, 2, 4, 6]


def test_splits_do_not_depend_on_partitioning(spark):
    frame = spark.range(997).withColumn("g", F.col("id") % 3)
    results = []
    for n in (1, 7):
        part = frame.repartition(n)
        results.append(
            [
                {(r.id, r.split) for r in f.select("id", "split").collect()}
                for f in (sampling.stratified_split(part, "g", 0.1, 42, "id"), sampling.ratio_split(part, "g", 0.8, 0.1, 0.1, 42, "id"), sampling.fixed_split(part, 50, 60, 42, "id"), sampling.hash_split(part, 10, 42, "id"))
            ]
        )
    assert results[0] == results[1]
    fixed = [s for _, s in results[0][2]]
    assert (fixed.count("dev"), fixed.count("test")) == (50, 60)


def test_ratio_split_counts_of_golden_sizes(spark):
    frame = spark.range(1000).withColumn("source", F.when(F.col("id") < 250, "a").when(F.col("id") < 750, "b").otherwise("c"))
    counts = {(r.source, r.split): r["count"] for r in sampling.ratio_split(frame, "source", 0.8, 0.1, 0.1, 42, "id").groupBy("source", "split").count().collect()}
    assert counts == {("a", "train"): 200, ("a", "dev"): 25, ("a", "test"): 25, ("b", "train"): 400, ("b", "dev"): 50, ("b", "test"): 50, ("c", "train"): 200, ("c", "dev"): 25, ("c", "test"): 25}
    with pytest.raises(ValueError):
        sampling.ratio_split(frame, "source", 0.8, 0.1, 0.2, 42, "id")


@pytest.mark.parametrize(("total", "stride", "length", "scored"), [(5000, 512, 2048, 4999), (100, 512, 2048, 99), (5000, 3000, 2048, 4046)])
def test_window_sums(spark, total, stride, length, scored):
    frame = spark.createDataFrame([(1, total)], "id int, total long")
    assert sequences.sliding_windows(frame, "total", stride, length).agg(F.sum("scored")).first()[0] == scored


def test_byte_level_matches_the_mapping(spark):
    text = "aé \n­😀"
    got = spark.createDataFrame([(text,)], "t string").select(sequences.byte_level("t")).first()[0]
    assert got == "".join(sequences.byte_characters()[b] for b in text.encode())


def test_alignment_raises_on_missing_lines(spark):
    a = spark.createDataFrame([(0, "x"), (1, "y")], "k int, t string")
    with pytest.raises(Exception, match="parts differ"):
        joins.aligned({"a": a, "b": a.filter("k = 0")}, "k").collect()


def test_replies_need_their_parent(spark):
    rows = [("1", None, "q", "user"), ("2", "1", "r", "assistant"), ("3", "9", "s", "assistant"), ("1", None, "p", "user")]
    frame = spark.createDataFrame(rows, "key string, parent string, text string, role string")
    got = joins.reply_pairs(frame, "key", "parent", "text", F.col("role") == "user", F.col("role") == "assistant").collect()
    assert [(r.key, r.instruction, r.output) for r in got] == [("2", "q", "r")]


def test_bigram_cosine(spark):
    frame = spark.createDataFrame([("can", "can"), ("can", "chien"), ("", "x")], "a string, b string")
    got = [r[0] for r in frame.select(evaluation.bigram_cosine("a", "b")).collect()]
    assert abs(got[0] - 1) < 1e-9 and 0 < got[1] < 1 and got[2] == 0


def test_chrf_of_equal_and_disjoint(spark):
    frame = spark.createDataFrame([(0, "lo can manja", "lo can manja"), (1, "xyz", "abc")], "k int, h string, r string")
    scores = {r.k: r.chrf for r in evaluation.chrf_score(evaluation.chrf_stats(frame, ["k"], "h", "r"), ["k"]).collect()}
    assert abs(scores[0] - 100) < 1e-9 and scores[1] == 0


def test_trace_keeps_pipes_in_tokens(spark):
    lines = ["Mode: token", "Case: Occitan", "Showing Probabilities for Layer: l.3", "a|b | 0.2 | 0.3 | 0.5", "junk | x | y | z", "Mode: sequence", "Showing Probabilities for Layer: l.4", "c | 1 | 0 | 0"]
    frame = spark.createDataFrame(list(enumerate(lines)), "n int, t string")
    got = [tuple(r) for r in routing.parse_trace(frame, "n", "t").orderBy("mode").collect()]
    assert got == [("sequence", "French", "l.4", 0, "c", [1.0, 0.0, 0.0]), ("token", "Occitan", "l.3", 0, "a|b", [0.2, 0.3, 0.5])]


def test_ties_merge_elects_signs(spark):
    rows = [("k", 0, "a", 1.0), ("k", 1, "a", -0.5), ("k", 0, "b", -2.0), ("k", 1, "b", -1.0)]
    frame = spark.createDataFrame(rows, "key string, idx int, model string, value double")
    got = {r.idx: r.value for r in vectors.ties_merge(frame, "key", "model", {"a": 0.5, "b": 0.5}, 1.0).collect()}
    assert got == {0: -2.0, 1: -0.75}
