"""Queries that must use every row and every character of their tables."""

import hashlib
import random
import re
from collections import Counter

from lexiforge.operators import sampling
from lexiforge.plans import corpus, evaluation, mixing, vectors


def conversations(spark, path, n, length):
    rnd = random.Random(5)
    say = lambda: " ".join("".join(rnd.choices("abcde", k=rnd.randint(1, 6))) for _ in range(rnd.randint(1, length)))
    rows = [(i, turn, role, say()) for i in range(n) for turn, role in ((0, "user"), (1, "assistant"))]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    return [(rows[k][3], rows[k + 1][3]) for k in range(0, len(rows), 2)]


def grams(text):
    chars, words = re.sub(r"\s+", "", text), text.split()
    found = {f"c{n}": Counter(chars[i : i + n] for i in range(len(chars) - n + 1)) for n in range(1, 7)}
    return found | {f"w{n}": Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) for n in (1, 2)}


def stats(hyp, ref):
    h, r = grams(hyp), grams(ref)
    return {o: (h[o].total(), r[o].total(), (h[o] & r[o]).total()) for o in h}


def score(rows):
    summed = {o: [sum(r[o][k] for r in rows) for k in range(3)] for o in rows[0]}
    usable = [(m / h, m / f) for h, f, m in summed.values() if h and f]
    p, r = (sum(x[k] for x in usable) / len(usable) for k in (0, 1)) if usable else (0, 0)
    return 100 * 5 * p * r / (4 * p + r) if p + r else 0.0


def test_chrf_reads_whole_texts(spark, tmp_path):
    pairs = conversations(spark, tmp_path, 30, 150)
    assert sum(len(t) > 200 for p in pairs for t in p) > 20
    each = [stats(b, a) for a, b in pairs]
    got = {(r.conv_id, r.order): (r.hyp, r.ref, r.match) for r in evaluation.chrf_stats(spark, str(tmp_path)).collect()}
    assert got == {(i, o): x for i, s in enumerate(each) for o, x in s.items() if x[0] or x[1]}
    assert abs(evaluation.chrf_corpus(spark, str(tmp_path)).first().chrf - score(each)) < 1e-5
    sentences = {r.conv_id: r.chrf for r in evaluation.chrf_sentence(spark, str(tmp_path)).collect()}
    assert all(abs(sentences[i] - score([s])) < 1e-5 for i, s in enumerate(each)) and len(sentences) == len(each)


def test_bootstrap_draws_from_all_pairs(spark, tmp_path):
    pairs = conversations(spark, tmp_path, 60, 12)
    sides = [(stats(a[::-1], a), stats(b, a)) for a, b in pairs]
    n, samples = len(pairs), 1000

    def difference(lines):
        return score([sides[i][1] for i in lines]) - score([sides[i][0] for i in lines])

    diffs = sorted(difference([int(hashlib.md5(f"42|{s}|{k}".encode()).hexdigest()[:8], 16) % n for k in range(n)]) for s in range(samples))
    least = min(sum(x <= 0 for x in diffs), sum(x >= 0 for x in diffs))
    expected = (difference(range(n)), diffs[int(0.025 * 999)], diffs[int(0.975 * 999)], min(1.0, 2 * (least + 1) / 1001))
    got = evaluation.bootstrap_chrf(spark, str(tmp_path)).first()
    assert all(abs(x - y) < 1e-5 for x, y in zip((got.difference, got.low, got.high, got.p_value), expected)), (got, expected)


def test_numbers_follow_the_order(spark):
    rnd = random.Random(3)
    keys = [(rnd.randrange(40), i) for i in range(5000)]
    rows = spark.createDataFrame(keys, "a int, b long").repartition(7)
    numbered, n = sampling.numbered(rows, "place", "a", "b")
    assert n == 5000 and [(r.a, r.b) for r in numbered.orderBy("place").collect()] == sorted(keys)
    assert sorted(r.place for r in numbered.collect()) == list(range(5000))
    empty, none = sampling.numbered(rows.limit(0), "place", "a", "b")
    assert none == 0 and empty.count() == 0


def test_weighted_init_uses_all_vectors(spark, tmp_path):
    rnd = random.Random(4)
    rows = [(i, [rnd.random(), rnd.random()], i % 7) for i in range(400)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    for r in vectors.weighted_init(spark, str(tmp_path)).collect():
        linked = [(1 + i % 3, v[r.idx]) for i, v, label in rows if label and i % 20 == r.token]
        assert abs(r.value - sum(w * x for w, x in linked) / sum(w for w, _ in linked)) < 1e-5


def test_shuffle_and_alignment_return_all_rows(spark, tmp_path):
    rows = [(7 * i % 1009, f"text {i}", ("en", "fr", "oc")[i % 3 if i < 300 else 0]) for i in range(500)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    order = sorted((hashlib.md5(f"42|{i}".encode()).hexdigest(), i) for i, _, _ in rows)
    assert [(r.place, r.doc_id) for r in corpus.seeded_shuffle(spark, str(tmp_path)).collect()] == [(k + 1, i) for k, (_, i) in enumerate(order)]
    en, fr = ([t for _, t, x in sorted(rows) if x == lang] for lang in ("en", "fr"))
    got = sorted((r.k, r.en, r.fr) for r in mixing.parallel_align(spark, str(tmp_path)).collect())
    assert got == [(k + 1, *both) for k, both in enumerate(zip(en, fr))] and len(got) == 100


def test_blocklist_has_the_boundaries_of_its_sql(spark, tmp_path):
    import duckdb

    ends = ["", "é", "e", "_", "7", "٣", "\u0301", "\u200d", "ß", ".", " ", "\n", "ſ", "日"]
    texts = [None, "", *(f"la station{x}" for x in ends), *(f"a{x}nation b" for x in ("\r", "\x85", "\u2028", "\u2029", "\n", "\v"))]
    texts += ["TION", "tıon", "TİON", "[12]", "[٣]", "[１]", "[]", "HTTPS://", "httpſ://", "http:/", "wiKipedia", "Wi\u212aipedia", "wıkipedia", "wİkipedia", "GOOGLE", "gooɡle"]
    rows = [(i, turn, role, text) for i, text in enumerate(texts) for turn, role in enumerate(("user", "assistant", "uſer", "uſeR x", "User\u0301", None))]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    with duckdb.connect() as db:
        expected = db.execute(corpus.ORACLE["blocklist_filter"].replace("FROM conversations", f"FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")).fetchall()
    got = [tuple(r) for r in corpus.blocklist_filter(spark, str(tmp_path)).collect()]
    assert 0 < len(expected) < len(rows) and sorted(got) == sorted(expected)
