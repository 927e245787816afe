"""Byte-level subwords against the library that the vocabulary's file is for."""

import collections
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexiforge.operators import subwords
from lexiforge.plans import subwords as plans

SF = "/root/testdata/sf0.001"
ODD = [
    "", None, " ", "\n\n \t x", "it's we'll I'M", "a" * 3000, "aaaa bbbb" * 50, "日本語 テキスト", "naïve café — œuvre", "😀😀 👩‍👩‍👧", "x y z　", "12 345,67 ½ ²",
    "<|endoftext|> as text", "é" * 700, "tab\tand\r\nlines \n", "'s 't 'veve", "ǅungla ß ſ", "​́a", "_under__score_", "€$%&/()=?`´",
]


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tool.encode_special_tokens = True
    return tool


@pytest.fixture(scope="module")
def held():
    return plans.vocabulary()


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_merges_equal_the_library(library, held):
    rnd = random.Random(5)
    for _ in range(500):
        word = "".join(rnd.choices("abcdeinrst éß", k=rnd.randrange(1, 30))).strip() or "x"
        if " " not in word:
            assert held.encode_word(word) == ids_of(library, word)


def test_ids_of_odd_texts(spark, library, held):
    rows = spark.createDataFrame([(i, t, t, "clash") for i, t in enumerate(ODD)], "id long, text string, other string, word string").repartition(3)
    got = subwords.decoded(subwords.encoded(rows, {"text": "ids", "other": "more"}, held, "id"), "ids", "again", held).collect()
    assert len(got) == len(ODD)
    for r in got:
        assert r.ids == r.more == ids_of(library, ODD[r.id]), ODD[r.id]
        assert r.again == (ODD[r.id] or "") and r.word == "clash"
    counts = {r.id: r.tokens for r in subwords.token_counts(rows, "text", held, "id").collect()}
    assert counts == {i: len(ids_of(library, t)) for i, t in enumerate(ODD) if t}
    assert subwords.encoded(rows.limit(0), {"text": "ids"}, held, "id").collect() == []


def test_queries_equal_the_library(spark, library):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    ids = {i: ids_of(library, t) for i, t in zip(docs.doc_id, docs.text)}
    got = plans.subword_ids(spark, SF).toPandas()
    assert len(got) == len(docs) and got.same.all()
    for r in got.itertuples():
        assert r.ids == " ".join(map(str, ids[r.doc_id][:128])) and r.n_tokens == len(ids[r.doc_id])
    report = plans.subword_fertility(spark, SF).toPandas().set_index("lang")
    for lang, own in docs.groupby("lang"):
        sizes, words = own.doc_id.map(lambda i: len(ids[i])), own.text.map(lambda t: len(t.split()))
        value = sizes / words.clip(lower=1)
        r = report.loc[lang]
        assert (r.n, r.tokens, r.words, r.n_high) == (len(own), sizes.sum(), words.sum(), (value > 2).sum()) and abs(r.fertility - value.mean()) < 1e-6


def test_candidates(spark, library, held):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    import regex

    counts = collections.Counter(w for t in docs.text for w in regex.findall(r"\p{L}+", t.lower()))
    got = plans.subword_candidates(spark, SF).toPandas().sort_values("id")
    assert got.id.tolist() == list(range(50257, 50257 + len(got))) and got.token.is_unique
    assert "the" not in set(got.token) and "tion" not in set(got.token)
    plain = library.get_vocab()
    for token in got.token:
        assert token not in plain
        if token not in ("l'", "ció"):
            word = token.lower()
            assert counts[word] >= 5 and len(word) >= 4 and len(ids_of(library, word)) > 1


def test_batches(spark, library):
    talk = pd.read_parquet(f"{SF}/conversations.parquet").set_index(["conv_id", "turn"])
    got = plans.subword_batches(spark, SF).toPandas().sort_values(["conv_id", "turn"])
    assert len(got) > 8 and [len(g) for _, g in got.groupby("batch")][:-1] == [8] * (got.batch.nunique() - 1)
    for r in got.itertuples():
        asked, answered = (ids_of(library, talk.loc[key].text) for key in ((r.conv_id, r.turn - 1), (r.conv_id, r.turn)))
        full = (asked + answered)[:64]
        full += [50256] * (len(full) < 64)
        ids, labels = ([int(x) for x in c.split()] for c in (r.input_ids, r.labels))
        assert ids[: len(full)] == full and set(ids[len(full) :]) <= {0} and len(ids) == len(labels)
        masked = min(len(asked), len((asked + answered)[:64]))
        assert labels[: len(full)] == [-100] * masked + full[masked:] and set(labels[len(full) :]) <= {-100}


def test_other_files_are_refused(tmp_path):
    import public_tokenizers

    with pytest.raises(ValueError, match="byte-level"):
        subwords.Vocabulary.load(public_tokenizers.path("word_bpe_49k.json"))


def test_words_cover_the_text(spark):
    for text in filter(None, ODD):
        assert "".join(spark.createDataFrame([(text,)], "t string").select(subwords.words(F.col("t")).alias("w")).first().w) == text
