"""Toxicity behind leetspeak, spacing and repetition: the decoder against brute force, the scores on held-out texts."""

import collections
import itertools
import math
import random

import numpy as np

from lexiforge.llm import toxicity
from lexiforge.llm.langid import held_out

DOCS = "doc_id long, text string, toxicity string, label int"
INSULTS = ["idiot", "moron", "loser", "clown", "pathetic"]


def prose(rnd, n):
    return [rnd.choice(["the", "and", "er", "in", "tion", "lo", "ha", "is"]) + rnd.choice(["ing", "ed", "ea", "nd", "", "st"]) for _ in range(n)]


def disguised(rnd, word):
    kind = rnd.randrange(4)
    if kind == 0:
        return "".join({"i": "1", "o": "0", "e": "3", "a": "@", "s": "$"}.get(c, c) for c in word)
    if kind == 1:
        return rnd.choice(" .-").join(word)
    if kind == 2:
        at = rnd.randrange(len(word))
        return word[:at] + word[at] * rnd.randrange(3, 6) + word[at + 1 :]
    return word.upper() + "!!"


def corpus(seed=1, n=400):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        words, toxic = prose(rnd, rnd.randrange(20, 80)), i % 4 == 0
        if toxic:
            for _ in range(3):
                words.insert(rnd.randrange(len(words)), rnd.choice(INSULTS))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def model_of(texts):
    counts = collections.Counter(w for t in texts for w in t.lower().split())
    return toxicity.log_probabilities(toxicity.count_grams(counts))


def test_grams_are_counted_within_words():
    tokens = collections.Counter({"abc": 2, "a-b": 1, "é9": 3})
    got = toxicity.count_grams(tokens)
    expected = collections.Counter()
    for word, n in [([1, 2, 3], 2), ([1], 1), ([2], 1), ([5, toxicity.DIGIT], 3)]:
        s = [0, 0, 0, *word, 0]
        for k in range(3, len(s)):
            expected[((s[k - 3] * 29 + s[k - 2]) * 29 + s[k - 1]) * 29 + s[k]] += n
    assert {int(k): int(got[k]) for k in np.flatnonzero(got)} == expected
    p = np.exp(toxicity.log_probabilities(got).reshape(-1, toxicity.SYMBOLS).astype(float))
    assert np.allclose(p.sum(axis=1), 1)


def brute_cost(log_p, seen, path):
    """path: of each character the letters emitted, a space, or None where it is dropped."""
    context, cost = 0, 0.0
    apart = [c in toxicity.SEPARATORS for c in seen]
    plain = [toxicity.READINGS[c][0] if c in toxicity.READINGS else c for c in seen]
    for i, (c, x) in enumerate(zip(seen, path)):
        run = len(list(itertools.takewhile(lambda k: plain[k] == plain[i], range(i, len(seen))))) + len(list(itertools.takewhile(lambda k: plain[k] == plain[i], range(i - 1, -1, -1))))
        one = lambda k, step: 0 <= k < len(seen) and not apart[k] and (not 0 <= k + step < len(seen) or apart[k + step])
        inside = 0 < i < len(seen) - 1
        singles = one(i - 1, -1) + one(i + 1, 1) if inside and not apart[i - 1] and not apart[i + 1] else 0
        if x is None:
            if apart[i]:
                if not singles:
                    return math.inf
                cost += toxicity.SPACED if singles == 1 else 0
            else:
                last = [y for y in path[:i] if y is not None]
                if i == 0 or plain[i] != plain[i - 1] or not last or last[-1] not in set(toxicity.READINGS.get(c, "")) | {c}:
                    return math.inf
                cost += toxicity.REPEATED if run > 2 else toxicity.DOUBLED
        elif x == " ":
            cost -= log_p[context * 29] if context else 0
            cost += toxicity.PARTED if (singles == 2 if apart[i] else inside) else 0
            context = 0
        else:
            symbol = toxicity.DIGIT if x.isdigit() else ord(x) - 96
            cost += toxicity.LEET if x != c else toxicity.DIGIT_KEPT if c.isdigit() else 0
            cost -= log_p[context * 29 + symbol]
            context = (context * 29 + symbol) % 29**3
    return cost - (log_p[context * 29] if context else 0)


def test_viterbi_finds_the_cheapest_path():
    log_p = model_of([" ".join(INSULTS), "the 10 lists of the day tell all"])
    decoder = toxicity.Decoder(log_p)
    rnd = random.Random(3)
    for _ in range(150):
        seen = "".join(rnd.choice("idotl10!$.- s") for _ in range(rnd.randrange(1, 7))).strip(toxicity.SEPARATORS)
        if not seen:
            continue
        options = []
        for c in seen:
            own = [None] if c in toxicity.SEPARATORS else [None, *toxicity.READINGS.get(c, ""), *([c] if c.isalnum() else [])]
            options.append(own + ([" "] if not c.isalnum() else []))
        best = min((brute_cost(log_p, seen, p), "".join(x or "" for x in p)) for p in itertools.product(*options))
        got = decoder.likeliest(seen)
        same = [p for p in itertools.product(*options) if " ".join("".join(x or "" for x in p).split()) == got]
        assert math.isclose(min(brute_cost(log_p, seen, p) for p in same), best[0], abs_tol=1e-5)


def test_disguises_are_undone():
    log_p = model_of([t for _, t, _ in corpus()])
    decoder = toxicity.Decoder(log_p)
    for seen, meant in {"1d10t": "idiot", "M0R0N!!": "moron", "l o s e r": "loser", "c.l.o.w.n": "clown", "idiooooot": "idiot", "i d 1 0 t": "idiot", "p@thet1c,": "pathetic", "iidiot": "idiot"}.items():
        assert decoder.restore(f"the {seen} ing") == f"the {meant} ing"
    assert decoder.restore(None) == decoder.restore(" \n 2024 *** ") == ""
    plain = " ".join(prose(random.Random(9), 200))
    assert decoder.restore(plain) == plain


def test_scores_of_held_out_texts(spark):
    rnd = random.Random(5)
    rows = corpus(n=1000)
    docs = spark.createDataFrame([(i, t, "clash", 9) for i, t, _ in rows], DOCS).repartition(3)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None), (10**6, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels.filter(~held_out()))
    scored = {r.doc_id: r.toxicity for r in toxicity.score(docs, model).collect()}
    assert sum((scored[i] >= toxicity.THRESHOLD) != bool(y) for i, _, y in rows) <= 5  # texts with one insult only
    hidden = [(i, " ".join(prose(rnd, 40) + [disguised(rnd, rnd.choice(INSULTS)) for _ in range(2)] + prose(rnd, 30))) for i in range(80)]
    clean = [(100 + i, " ".join(prose(rnd, 300 * (i + 1)))) for i in range(10)] + [(200, None), (201, ""), (202, "1 2 3 a b c 4 5"), (203, "é" * 5000), (204, "a " * 5000)]
    odd = spark.createDataFrame([(i, t, "x", 1) for i, t in hidden + clean], DOCS)
    scored = {r.doc_id: r.toxicity for r in toxicity.score(odd, model).collect()}
    assert sum(scored[i] >= toxicity.THRESHOLD for i, _ in hidden) >= 72  # nine of ten
    assert not any(scored[i] >= toxicity.THRESHOLD for i, _ in clean)
    assert scored[200] == scored[201]
    assert toxicity.score(docs.limit(0), model).collect() == []
    again = toxicity.train(docs.repartition(7), labels.filter(~held_out()))
    assert again.weights == model.weights and again.bias == model.bias


def test_without_labels_or_with_one_class(spark):
    docs = spark.createDataFrame([(1, "so", "x", 1), (2, None, "x", 1)], DOCS)
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert [round(r.toxicity) for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()] == [1, 1]
    assert [round(r.toxicity) for r in toxicity.score(docs, toxicity.train(docs, labels.limit(0))).collect()] == [0, 0]
    empty = toxicity.train(docs.limit(0), labels.limit(0))
    assert toxicity.score(docs.limit(0), empty).collect() == []


def test_restored_texts(spark):
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t, _ in corpus(n=50)] + [(99, "M0r0n\tm.o.r.o.n", "x", 1)], DOCS)
    got = {r.doc_id: r for r in toxicity.restore(docs, toxicity.language_model(docs)).collect()}
    assert got[99].restored == "moron moron" and got[99].toxicity == "x"
