"""Periodic runs against brute force."""

import hashlib
import random
import re
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from lexiforge.llm import runs

DOCS = "doc_id long, text string, runs string, n int"


def brute(s):
    found, n = {}, len(s)
    for q in range(1, n // 4 + 1):
        start = 0
        for i in range(q, n + 1):
            if i == n or s[i] != s[i - q]:
                if i - start >= max(6, 4 * q):
                    found.setdefault((start, i), q)
                start = i - q + 1
    return sorted((a, b - a, q) for (a, b), q in found.items())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=5), st.integers(1, 9)), max_size=8))
def test_runs_of_repeated_blocks(blocks):
    s = [x for block, times in blocks for x in block * times]
    assert runs.runs_of(s) == brute(s) == runs.find_runs([b"%d" % x for x in s])


def test_runs_of_random_strings_and_copied_stretches():
    rnd = random.Random(2)
    for _ in range(2000):
        s = []
        while len(s) < rnd.randrange(80):
            s += [rnd.randrange(3) for _ in range(rnd.randrange(1, 6))] * rnd.randrange(1, 6)
            at = rnd.randrange(len(s))
            s += s[at : at + rnd.randrange(30)]
        assert runs.runs_of(s) == brute(s) == runs.find_runs([b"%d" % x for x in s])


def test_factors_are_the_longest_earlier_strings():
    rnd = random.Random(4)
    for _ in range(200):
        s = [rnd.randrange(3) for _ in range(rnd.randrange(1, 40))]
        at = 0
        for start, size, earlier in runs.factors(s):
            assert start == at
            longest = max((k for k in range(1, len(s) - at + 1) if any(s[j : j + k] == s[at : at + k] for j in range(at))), default=0)
            assert size == max(longest, 1) and (earlier < 0) == (longest == 0)
            assert earlier < 0 or s[earlier : earlier + size] == s[at : at + size]
            at += size
        assert at == len(s)


def expected(i, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(i).encode()) if i is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
    found = brute(words)
    top = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    gone = {k for start, length, q in found for k in range(start + q, start + length)}
    kept = " ".join(w for k, w in enumerate(words) if k not in gone)
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    return (i, len(found), *best, digest("".join(f"{a},{b},{q}\n" for a, b, q in found)), digest(kept))


def test_query_equals_brute_force(spark, tmp_path):
    rnd = random.Random(7)
    rows = [(i, " ".join(rnd.choice("abcde") for _ in range(rnd.randrange(60)))) for i in range(300)]
    rows += [(400, None), (401, ""), (402, " \t\n"), (403, "a b a b " * 5), (404, "x " * 5), (405, "x\x0b" * 6), (406, "a b " * 4 + "a c " * 5), (407, "é ü\r\n" * 9), (408, "\x1ca " * 7), (None, "w " * 9)]
    rows += [(409 + k, " ".join(rnd.choice(["lo", "la", "can"]) for _ in range(900))) for k in range(40)]
    rows += [(406, "a b " * 4 + "a c " * 5)]
    spark.createDataFrame([(*r, "clash", 1) for r in rows], DOCS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((tuple(r) for r in runs.query(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted((expected(*r) for r in rows), key=str)


def test_general_interface(spark):
    docs = spark.createDataFrame([(1, "so so so so so so on and on and on and on and on", "clash", 1), (2, None, "x", 2)], DOCS)
    one, two = sorted(runs.periodic_runs(docs).collect(), key=lambda r: r.doc_id)
    assert [tuple(r) for r in one.runs] == [(0, 6, 1), (6, 9, 2)] and tuple(one.top_run) == (0, 6, 1)
    assert one.collapsed == "so on and" and one.n == 1 and (two.runs, two.top_run, two.collapsed, two.n_words) == ([], None, "", 0)
    assert runs.periodic_runs(docs.limit(0)).collect() == []
    long = spark.createDataFrame([(1, "lo gat manja " * 50_000)], "id long, body string")
    assert runs.periodic_runs(long, "body").first().collapsed == "lo gat manja"
