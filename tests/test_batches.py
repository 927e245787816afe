"""What Python workers hold at a time."""

import random
import threading

import psutil
import pyarrow as pa
from pyspark.sql import functions as F

from lexiforge.functions.batches import parts
from lexiforge.operators import sequences, subwords
from lexiforge.plans import subwords as plans


def peak_mb(run):
    """run()'s result, and the most that one Python worker held meanwhile."""
    most, over = [0.0], threading.Event()

    def watch():
        while not over.wait(0.05):
            for p in psutil.Process().children(recursive=True):
                try:
                    if "pyspark" in " ".join(p.cmdline()) and "java" not in p.name():
                        most[0] = max(most[0], p.memory_info().rss / 1e6)
                except psutil.Error:
                    pass

    thread = threading.Thread(target=watch)
    thread.start()
    try:
        return run(), most[0]
    finally:
        over.set()
        thread.join()


def corpus(spark, n, length):
    """n texts of about ``length`` characters in a single partition."""
    rnd = random.Random(3)
    words = ["".join(rnd.choices("abcdefghij", k=rnd.randint(2, 9))) for _ in range(500)]
    texts = [" ".join(rnd.choices(words, k=length // 6)) for _ in range(50)]
    return spark.range(n, numPartitions=1).select("id", F.get(F.array(*map(F.lit, texts)), (F.col("id") % 50).cast("int")).alias("text"))


def test_parts_hold_each_row_once():
    texts = ["", None, "é" * 3, "abc", "x" * 50, "", "y", None, "zz"]
    batch = pa.RecordBatch.from_pydict({"i": list(range(len(texts))), "t": texts, "l": [None if t is None else list(t) for t in texts]})
    for column in ("t", "l"):
        for limit in (1, 6, 9, 1000):
            got = list(parts(batch.slice(1), column, limit))
            assert [r for p in got for r in p.to_pylist()] == batch.slice(1).to_pylist() and all(len(p) for p in got)
            sizes = [[len((t or "").encode()) if column == "t" else len(t or "") for t in p.column("t").to_pylist()] for p in got]
            assert all(sum(s) <= limit or sum(s[:-1]) == 0 for s in sizes)
    assert not list(parts(batch.slice(0, 0), "t"))


def test_library_tokens_hold_a_part_of_a_batch(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = corpus(spark, 4000, 6000)
    seen = sequences.library_tokens(rows, "text", path).agg(F.count("*"), F.sum(F.size("tokens")), F.count_if(F.col("text") != F.col("decoded")))
    (n, tokens, wrong), most = peak_mb(lambda: tuple(seen.first()))
    tool = Tokenizer.from_file(path)
    assert (n, tokens, wrong) == (4000, 80 * sum(len(tool.encode(r.text).ids) for r in rows.limit(50).collect()), 0)
    assert most < 450, most


def test_library_tokens_of_odd_texts(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tool = Tokenizer.from_file(path)
    texts = [None, "", " ", "<|endoftext|> x", "é日本 😀", "a\n\n b", "Ã"]
    got = sequences.library_tokens(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "text", path).collect()
    assert len(got) == len(texts)
    for r in got:
        found = tool.encode(texts[r.id] or "", add_special_tokens=False)
        assert r.text == texts[r.id] and r.tokens == found.tokens and r.decoded == tool.decode(found.ids, skip_special_tokens=False)


def test_subwords_are_not_shuffled(spark, tmp_path):
    corpus(spark, 600, 6000).withColumnRenamed("id", "doc_id").withColumn("lang", F.lit("fr")).write.parquet(f"{tmp_path}/documents.parquet")
    found = plans.subword_ids(spark, str(tmp_path))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    (n, same), most = peak_mb(lambda: tuple(found.agg(F.count("*"), F.count_if("same")).first()))
    assert (n, same) == (600, 600)
    assert most < 450, most


def test_words_are_kept_within_bounds(monkeypatch):
    held = plans.vocabulary()
    words = [" one", "two", " one", "x" * 60, "", "é", "three", "two", "four"]
    alone = [held.encode_word(w) for w in words]
    monkeypatch.setattr(subwords, "MOST_KEPT", 2)
    for _ in range(2):
        sizes, ids = held.encode_words(pa.array(words, pa.string()))
        assert sizes.tolist() == [len(x) for x in alone] and ids.tolist() == sum(alone, [])
        assert len(held._kept) <= 2 and "x" * 60 not in held._kept
    sizes, ids = held.encode_words(pa.array([], pa.string()))
    assert not len(sizes) and not len(ids)


def test_texts_of_several_columns_in_parts(spark, monkeypatch):
    held = plans.vocabulary()
    texts = [None, "", "a b c", "l'été " * 9, "\n", "x", None, "one two"]
    rows = spark.createDataFrame([(i, t, u) for i, (t, u) in enumerate(zip(texts, texts[::-1]))], "id int, t string, u string").coalesce(1)
    monkeypatch.setattr(subwords, "PART_VALUES", 3)
    got = subwords.decoded(subwords.encoded(rows, {"t": "t", "u": "ids"}, held, "id"), "ids", "again", held).orderBy("id").collect()
    assert [r.u for r in got] == texts[::-1] == [r.u if r.u is None else r.again for r in got]
    assert [held.decode(r.t) for r in got] == [t or "" for t in texts] and got[0].t == []
