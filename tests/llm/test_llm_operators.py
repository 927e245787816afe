"""Training-data operators against brute force, on small fixtures with awkward rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexiforge.llm import attribution, bpe, extraction, graph, jaccard, langid, media, neighbours, packing, passages, suffixes, unigram, urls
from lexiforge.llm.common import Scratch

DOCS = "doc_id long, text string, lang string, id string, n int"


def words(seed, n):
    rnd = random.Random(seed)
    return [rnd.choice(["lo", "la", "can", "gat", "manja", "pan", "ostal", "camin", "vila", "mar"]) + str(rnd.randrange(50)) for _ in range(n)]


def corpus():
    base, other = words(1, 120), words(2, 90)
    edited = base[:]
    edited[60] = "cambiat"
    far = base[:30] + words(3, 90)
    rows = [" ".join(base), " ".join(base).upper(), " ".join(edited), " ".join(far), " ".join(other), " ".join(other + ["fin"]), "a b c", "A b\tc", "", "   ", None, "sol", "café café " * 300]
    return [(i, t) for i, t in enumerate(rows)]


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "oc", "clash", 3) for i, t in rows], DOCS).repartition(3)


def shingles(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(found) < 5:
        return frozenset([tuple(found)]) if found else frozenset()
    return frozenset(tuple(found[i : i + 5]) for i in range(len(found) - 4))


def brute_components(rows):
    sets = {i: shingles(t) for i, t in rows}
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if a != b and sets[a] and 100 * both >= 75 * len(sets[a] | sets[b]) and label[a] != label[b]:
                    low = min(label[a], label[b])
                    label[a] = label[b] = low
                    changed = True
    return {i: (len(sets[i]), label[i]) for i in sets}


def test_jaccard_equals_brute_force(spark):
    rows = corpus()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(documents(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_jaccard_with_frequent_tokens(spark, monkeypatch):
    """With a low threshold most tokens are indexed in pairs; nothing may be lost."""
    rnd = random.Random(5)
    rows = []
    for family in range(4):
        base = words(100 + family, 60)
        for _ in range(12):
            copy = base[:]
            for _ in range(rnd.randrange(4)):
                copy[rnd.randrange(60)] = f"x{rnd.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy[: rnd.randrange(50, 61)])))
    expected = brute_components(rows)
    for frequent in (3, 64):
        sets = [np.array(sorted(jaccard.shingle_sets([t.encode()])[0])) for _, t in rows]
        counts = collections.Counter(int(x) for s in sets for x in s)
        monkeypatch.setattr(jaccard, "FREQUENT", frequent)
        marks = []
        for s in sets:
            shared = np.array([x for x in s if counts[int(x)] > 1], np.uint64)
            frequency = np.array([min(counts[int(x)], 255) for x in shared])
            order = np.lexsort((shared, frequency))
            marks.append(set(jaccard.signatures(shared[order], frequency[order], len(s)).tolist()))
        for a in range(len(rows)):
            for b in range(a):
                x, y = shingles(rows[a][1]), shingles(rows[b][1])
                if x != y and 100 * len(x & y) >= 75 * len(x | y):
                    assert marks[a] & marks[b]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(documents(spark, rows)).collect()}
    assert got == expected


@pytest.mark.parametrize("frequent", [3, 64])
def test_jaccard_around_the_threshold(spark, monkeypatch, frequent):
    """Families whose members mostly do not link with their centre, but with one another in chains."""
    rnd = random.Random(6)
    rows = []
    for family in range(3):
        base = words(200 + family, 80)
        for _ in range(6):
            stem = base[:]
            for _ in range(rnd.randrange(3, 6)):
                stem[rnd.randrange(80)] = f"y{rnd.randrange(10**6)}"
            for _ in range(5):
                copy = stem[:]
                for _ in range(rnd.randrange(4)):
                    copy[rnd.randrange(80)] = f"z{rnd.randrange(10**6)}"
                rows.append((len(rows), " ".join(copy)))
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(documents(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_difference_prefixes_lose_no_link():
    """Similar sets that are not both similar to a third one share a token of the prefixes of their differences to it."""
    rnd = random.Random(8)
    seen = 0
    for _ in range(4000):
        n = rnd.choice([20, 40, 90])
        centre = rnd.sample(range(1000), n)
        edit = lambda s, k: [x for x in s if x not in set(rnd.sample(sorted(set(s)), min(k, len(set(s)))))] + rnd.sample(range(1000, 1400), k)
        stem = edit(centre, rnd.randrange(n // 4))
        sets = [np.array(sorted(set(x)), np.uint64) for x in (edit(stem, rnd.randrange(max(1, n // 8))), edit(stem, rnd.randrange(max(1, n // 8))), centre)]
        held = [rnd.randrange(4), rnd.randrange(4), rnd.randrange(4)]  # tokens that no other text has
        n_u, n_v, n_p = (len(s) + h for s, h in zip(sets, held))

        def similar(x, y, m, k):
            both = len(np.intersect1d(x, y))
            return jaccard.DENOMINATOR * both >= jaccard.NUMERATOR * (m + k - both)

        u, v, p = sets
        linked = [similar(u, p, n_u, n_p), similar(v, p, n_v, n_p)]
        if not similar(u, v, n_u, n_v) or all(linked):
            continue
        seen += 1
        levels = [(x % 7).astype("u1").tobytes() for x in sets]
        prefixes = [jaccard.difference_prefix(x.tobytes(), l, p.tobytes(), levels[2], k, n_p, flag) for x, l, k, flag in zip(sets, levels, (n_u, n_v), linked)]
        assert len(np.intersect1d(*(x[2] for x in prefixes)))
        alone = sum(x[1] for x in prefixes) + sum(int(x).bit_count() for x in (prefixes[0][3] ^ prefixes[1][3]).view(np.uint64))
        assert alone <= n_u + n_v - 2 * len(np.intersect1d(u, v))
    assert seen > 100


def test_empty_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    assert jaccard.near_duplicates(empty).count() == 0
    assert packing.pack_documents(empty).count() == 0
    assert passages.remove_repeats(empty, keep=["doc_id"]).count() == 0
    assert langid.train(empty) is None and langid.identify(empty, None).count() == 0
    assert unigram.encode_documents(empty).count() == 0
    assert attribution.count_tokens(empty, ["text"]).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert extraction.extract_pages(pages).count() == 0 and urls.judge_urls(pages).count() == 0
    assert neighbours.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0


def brute_repeats(texts, size):
    counts = collections.Counter(t[i : i + size] for t in texts for i in range(len(t) - size + 1))
    return [[i <= len(t) - size and counts[t[i : i + size]] > 1 for i in range(len(t))] for t in texts]


def test_suffix_arrays_equal_brute_force():
    rnd = random.Random(1)
    for _ in range(150):
        size, letters = rnd.choice([1, 3, 8, 9, 16]), rnd.choice([b"ab", b"\0a", b"\0", b"abcdefgh"])
        texts = [bytes(rnd.choice(letters) for _ in range(rnd.choice([0, 1, 5, 30, 80]))) for _ in range(rnd.randint(1, 8))]
        got = [x.tolist() for x in suffixes.repeated_starts(texts, size, rnd.choice([10, 60, 10_000]))]
        assert got == brute_repeats(texts, size)


def test_passages_equal_brute_force(spark, tmp_path):
    shared = "passatge " + " ".join(words(9, 60))
    rows = [
        (0, shared), (1, "abans " + shared + " aprèp"), (2, " ".join(words(10, 80))), (3, "a" * 450), (4, None), (5, ""), (6, "curt"),
        (7, shared[:230] + "Z" + " ".join(words(11, 50))), (8, " ".join(words(12, 40)) + shared[100:350]), (9, "è" * 150), (10, "é" * 99 + " " + " ".join(words(13, 40))),
    ]
    rows += [(20, rows[2][1])]
    raws = [(t or "").encode() for _, t in rows]
    expected = {}
    for (i, _), raw, flags in zip(rows, raws, brute_repeats(raws, passages.SIZE)):
        covered = np.zeros(len(raw), bool)
        for k in np.flatnonzero(flags):
            covered[k : k + passages.SIZE] = True
        kept = bytes(b for b, c in zip(raw, covered) if not c)
        runs = int(np.diff(np.concatenate([[0], covered.astype(int)])).clip(0).sum())
        expected[i] = (len(raw), int(covered.sum()), runs, hashlib.sha256(kept).hexdigest(), kept)
    documents(spark, rows).write.parquet(str(tmp_path / "docs"))  # read twice, so it must be a stored table
    got = passages.remove_repeats(spark.read.parquet(str(tmp_path / "docs"))).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in got} == expected
    assert all(r.id == "clash" and r.n == 3 for r in got)


@pytest.mark.parametrize("hot", [2, 20])
def test_a_hot_line_in_many_surroundings(spark, tmp_path, monkeypatch, hot):
    """A line that every third document has, in surroundings of its own or in shared ones, against brute force."""
    monkeypatch.setattr(passages, "HOT_ANCHOR", hot)
    monkeypatch.setattr(passages, "STRETCH_SHARD_BYTES", 4000)
    monkeypatch.setattr(passages, "ARRAY_BYTES", 2000)
    rnd = random.Random(17)
    own = lambda n: "".join(rnd.choices("abcdefghij ", k=n))
    line, before, behind = own(110), [own(60) for _ in range(3)], [own(90) for _ in range(3)]
    rows = []
    for i in range(150):
        text = own(rnd.randrange(250))
        if i % 3 == 0:
            text += rnd.choice([own(80), *before]) + line + rnd.choice([own(80), *behind, "", behind[0][:40] + own(60)])
        rows.append((i, text + own(rnd.randrange(100))))
    raws = [t.encode() for _, t in rows]
    expected = {}
    for (i, _), raw, flags in zip(rows, raws, brute_repeats(raws, passages.SIZE)):
        covered = np.zeros(len(raw), bool)
        for k in np.flatnonzero(flags):
            covered[k : k + passages.SIZE] = True
        expected[i] = bytes(b for b, c in zip(raw, covered) if not c)
    assert any(len(expected[i]) < len(t) for i, t in enumerate(raws))
    documents(spark, rows).write.parquet(str(tmp_path / "docs"))
    got = passages.remove_repeats(spark.read.parquet(str(tmp_path / "docs"))).collect()
    assert {r.doc_id: bytes(r.kept) for r in got} == expected


def test_digests_of_a_hot_line_spread(spark, tmp_path, monkeypatch):
    """A line of 190 bytes in thousands of texts, in surroundings of their own: no bucket grows with their number."""
    rnd = random.Random(23)
    own = lambda n: "".join(rnd.choices("abcdefghij ", k=n))
    line, foot = own(190), own(40)
    rows = [(i, own(rnd.randrange(60, 150)) + line + (foot if i % 50 == 0 else "") + own(rnd.randrange(60, 150))) for i in range(3000)]
    texts = [t.encode() for _, t in rows]
    pairs = []
    for block in passages._blocks(texts):
        hashes = passages.Hashes(block.text)
        for a, n in zip(block.piece_starts, [len(texts[k]) for k in block.number]):
            pairs.append(passages._string_digests(hashes, np.arange(a, a + n - passages.SIZE + 1)))
    sizes = [len(payload) // 17 for _, _, payload in passages._digest_rows(1, pairs, 10)]
    assert max(sizes) < 3 * sum(sizes) / 1024
    monkeypatch.setattr(passages, "HOT_ANCHOR", 100)
    taken = []
    monkeypatch.setattr(passages, "SHARD_BYTES", 60_000)
    documents(spark, rows).write.parquet(str(tmp_path / "docs"))
    got = {r.doc_id: bytes(r.kept) for r in passages.remove_repeats(spark.read.parquet(str(tmp_path / "docs"))).collect()}
    seen = {}
    for i, t in enumerate(texts):
        for k in range(len(t) - passages.SIZE + 1):
            string = t[k : k + passages.SIZE]
            seen[string] = seen.get(string, 0) + 1
    for (i, _), t in zip(rows, texts):
        covered = np.zeros(len(t), bool)
        for k in range(len(t) - passages.SIZE + 1):
            if seen[t[k : k + passages.SIZE]] > 1:
                covered[k : k + passages.SIZE] = True
        assert got[i] == bytes(b for b, c in zip(t, covered) if not c)
        taken.append(covered.any())
    assert 40 < sum(taken) < 2990


def test_passages_at_the_edges_of_texts(spark, tmp_path):
    """Copies whose stretches differ only by what follows or precedes: once cut to what is likely, they can be one text."""
    rnd = random.Random(7)
    own = lambda n: "".join(rnd.choices("abcdefghij ", k=n))
    rows = []
    for i in range(500):
        shared = own(rnd.choice([200, 201, 260, 330]))
        rows += [(2 * i, shared), (2 * i + 1, shared + own(150) if i % 3 else own(150) + shared)]
    raws = [t.encode() for _, t in rows]
    expected = {}
    for (i, _), raw, flags in zip(rows, raws, brute_repeats(raws, passages.SIZE)):
        covered = np.zeros(len(raw), bool)
        for k in np.flatnonzero(flags):
            covered[k : k + passages.SIZE] = True
        expected[i] = bytes(b for b, c in zip(raw, covered) if not c)
    documents(spark, rows).write.parquet(str(tmp_path / "docs"))
    got = passages.remove_repeats(spark.read.parquet(str(tmp_path / "docs"))).collect()
    wrong = [r.doc_id for r in got if bytes(r.kept) != expected[r.doc_id]]
    assert len(got) == len(rows) and not wrong, wrong


def test_long_texts_are_read_in_pieces(spark, monkeypatch):
    long = " ".join(words(21, 4000))
    texts = [long.encode(), ("x" + long[5000:9000]).encode()]
    for piece in (1 << 20, 3000):
        monkeypatch.setattr(passages, "PIECE_BYTES", piece)
        starts = sum(int((b.first["end"] - b.first["begin"]).sum()) for b in passages._blocks(texts) if b.any)
        assert starts == sum(len(t) - passages.SIZE + 1 for t in texts)


def test_packing_places_every_id_once(spark):
    rows = corpus() + [(100 + i, " ".join(words(i, 40 * (i % 30)))) for i in range(60)]
    got = packing.pack_documents(documents(spark, rows), capacity=128).toPandas()
    encode = bpe.encoder(bpe.vocabulary_path())
    for i, text in rows:
        ids = np.array([*encode.tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        mine = got[got.id == i].sort_values("start")
        assert b"".join(mine.ids) == ids.tobytes() and set(mine.doc_tokens) == {len(ids)}
        assert all(zlib.crc32(x) == c for x, c in zip(mine.ids, mine.ids_crc32))
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.length.sum() <= 128
    sizes = got.groupby("sequence_id").length.sum()
    assert (sizes < 128).sum() <= 3


def test_fast_encoding_is_that_of_the_tokenizer():
    encode = bpe.encoder(bpe.vocabulary_path())
    for text in ["", " ", "  a  b", "it's 12 3\n\n x\t y ", "<|endoftext|> a", "日本 é ñ ß", "a b\x85c\x1cd", "don't! (yes) … 😀"]:
        assert encode.encode(text) == np.array(encode.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_attribution_sums_to_the_document(spark):
    rows = [(1, "lo can\nmanja\n\nlo pan é"), (2, None), (3, ""), (4, "sola linha"), (5, "\n")]
    encode = bpe.encoder(bpe.vocabulary_path())
    for rule in attribution.RULES:
        got = attribution.count_tokens(documents(spark, rows), ["lang", "text"], rule=rule, sections="lines").toPandas()
        for i, text in rows:
            n = len(encode.encode("oc\n" + (text or ""))) // 4
            assert abs(got[got.id == i].n_tokens.sum() - n) < 1e-9
    starts, ends = np.array([0, 3, 5]), np.array([3, 5, 9])
    bounds = np.array([0, 4, 6, 9])
    assert attribution.attribute(starts, ends, bounds, "start")[0].tolist() == [2, 1, 0]
    assert attribution.attribute(starts, ends, bounds, "most")[0].tolist() == [2, 0, 1]
    assert attribution.attribute(starts, ends, bounds, "share")[0].tolist() == [1.5, 0.75, 0.75]


def test_unigram_finds_the_best_path_and_decodes():
    codec = unigram.codec(unigram.vocabulary_path())
    ids = {p: i for i, p in enumerate(codec.v.pieces) if codec.v.usable[i]}
    longest = max(map(len, ids))

    def best(text):
        score = [0.0] + [float("-inf")] * len(text)
        for a in range(len(text)):
            if text[a] not in ids:
                score[a + 1] = max(score[a + 1], score[a] + codec.unknown_score)
            for b in range(a + 1, min(len(text), a + longest) + 1):
                if text[a:b] in ids:
                    score[b] = max(score[b], score[a] + codec.v.scores[ids[text[a:b]]])
        return score[-1]

    for text in ["", "a", "lo can manja lo pan", "  dos  espacis ", "\n\nlinha\tx", "日本語 😀", "un ▁ marcador", "é" * 50]:
        got = codec.encode(text)
        assert codec.decode(got) == text
        if text and "▁" not in text:
            total, k = 0.0, 0
            while k < len(got):
                if got[k] in codec.v.byte_ids:
                    lead = codec.v.byte_ids.index(got[k])
                    total, k = total + codec.unknown_score, k + (1 if lead < 128 else 2 if lead < 224 else 3 if lead < 240 else 4)
                else:
                    total, k = total + codec.v.scores[got[k]], k + 1
            assert abs(total - best("▁" + text.replace(" ", "▁"))) < 1e-6


def _message(fields):
    """A protocol buffer message of (number, bytes or int)."""
    varint = lambda n: bytes([*((n >> s & 127) | 128 for s in range(0, 7 * ((max(n, 1).bit_length() - 1) // 7), 7)), n >> 7 * ((max(n, 1).bit_length() - 1) // 7)])
    return b"".join(varint(k << 3 | (0 if isinstance(v, int) else 2)) + (varint(v) if isinstance(v, int) else varint(len(v)) + v) for k, v in fields)


def test_ids_are_those_of_sentencepiece(tmp_path):
    """The vocabulary written as a model of the unigram kind with the same log scores, and encoded by SentencePiece."""
    import sentencepiece

    path = unigram.vocabulary_path()
    ours = unigram.codec(path)
    assert all(s < 0 for s, u in zip(ours.v.scores, ours.v.usable) if u)
    assert abs(sum(2.718281828459045**s for s, u in zip(ours.v.scores, ours.v.usable) if u) - 1) < 0.01
    parts, i = [], 0
    for number, value in unigram._fields(open(path, "rb").read()):
        if number == 1:
            held = dict(unigram._fields(value))
            if ours.v.usable[i]:
                score = b"\x15" + np.float32(ours.v.scores[i]).tobytes()
                value = _message([(1, held[1])]) + score
            i += 1
        elif number == 2:
            value = _message([(k, unigram._UNIGRAM if k == 3 else v) for k, v in unigram._fields(value) if k in (3, 35, 40, 41, 42, 43, 45, 46, 47, 48)])
        parts.append((number, value))
    model = tmp_path / "unigram.model"
    model.write_bytes(_message(parts))
    theirs = sentencepiece.SentencePieceProcessor(model_file=str(model))
    rnd = random.Random(2)
    texts = ["hello world", "  two  spaces ", "tab\tand\nline\n\n feed", "日本語 😀 ñandú", "a", " ", "\n", "x" * 300, "internationalization of the thing"]
    texts += ["".join(rnd.choices("abcdefghij éß日 \n.,'0", k=rnd.randrange(1, 120))) for _ in range(300)]
    again = unigram.Codec(unigram.read_pieces(str(model)))
    for text in texts:
        assert list(ours.encode(text)) == theirs.encode(text) == list(again.encode(text)), text
        assert ours.decode(ours.encode(text)) == text


def test_long_words_are_solved_in_windows(monkeypatch):
    codec = unigram.codec(unigram.vocabulary_path())
    rnd = random.Random(3)
    words = ["".join(rnd.choices("abcdeé日", k=900)), "the" * 500, "x" * 700, "\u4e00" * 300]
    whole = [codec.viterbi(w) for w in words]
    for window in (32, 200):
        monkeypatch.setattr(unigram, "_WINDOW", window)
        assert [codec.viterbi(w) for w in words] == whole
    monkeypatch.undo()
    long = "abcdefgh" * 60_000
    assert codec.decode(codec.encode(long)) == long


def test_encoding_of_repeated_and_null_rows(spark):
    rows = [(1, "lo can"), (1, "lo can"), (None, None), (2, "")]
    got = unigram.encode_documents(documents(spark, rows)).collect()
    assert sorted((r.id or 0, len(r.ids), r.decoded) for r in got) == [(0, 0, ""), *[(1, len(got[0].ids) or len(max(got, key=lambda r: len(r.ids)).ids), "lo can")] * 2, (2, 0, "")]


def test_language_identification(spark):
    sets = {"aa": "la le li lo lu", "bb": "ka ke ki ko ku"}
    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choices(sets[k].split(), k=20)), k, "c", 1) for i, k in enumerate(["aa", "bb"] * 40)]
    rows += [(900, None, "aa", "c", 1), (901, "123 !!", None, "c", 1), (902, "", "bb", "c", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: (r.lang_pred, r.lang_score, r.id) for r in langid.identify(docs, langid.train(docs)).collect()}
    assert all(got[i][0] == k for i, _, k, _, _ in rows if i < 900)
    assert all(got[i][:2] == ("und", 0.0) for i in (900, 901, 902))
    assert all(0 <= s <= 1 and c == "c" for _, s, c in got.values())


def test_kernel_and_regression_equal_brute_force():
    """Kernel values from sets of n-grams, and the solution of the ridge problem in Nyström features."""
    rnd = random.Random(5)
    texts = ["".join(rnd.choices("abcdefg éñ", k=rnd.randrange(5, 60))) for _ in range(40)]
    labels = [rnd.choice("xyz") for _ in texts]
    rows = langid.presence(texts)

    def grams(text):
        text = f" {re.sub(r'[^a-zéñ]+', ' ', text).strip()} "
        codes = [[ord(c) for c in text[i : i + n]] for n in langid.NGRAMS for i in range(len(text) - n + 1)]
        numbers = np.array([sum(c << (21 * (len(g) - 1 - k)) for k, c in enumerate(g)) + len(g) & (2**64 - 1) for g in codes], np.uint64)
        return set((langid.mix64(numbers) >> np.uint64(51)).tolist())

    sets = [grams(t) for t in texts]
    model = langid.fit(rows, labels, n_landmarks=12)
    chosen = [i for name in sorted(set(labels)) for i in [k for k, label in enumerate(labels) if label == name][: 12 // len(set(labels))]]
    kernel = np.array([[len(a & sets[j]) / (len(a) ** 0.5 * len(sets[j]) ** 0.5) for j in chosen] for a in sets])
    assert np.allclose(model.kernel(rows), kernel, atol=1e-5)
    # the same problem in its dual form: minimise weighted squares plus the ridge on w' K w
    weight = np.array([1 / labels.count(label) for label in labels])
    weight /= weight.sum()
    target = np.array([[1.0 if label == name else -1.0 for name in sorted(set(labels))] for label in labels])
    x, y = kernel - weight @ kernel, target - weight @ target
    between = kernel[chosen]
    solved = np.linalg.lstsq(x.T @ (weight[:, None] * x) + langid.RIDGE / len(labels) * between, x.T @ (weight[:, None] * y), rcond=1e-10)[0]
    assert np.allclose(x @ solved, model.scores(rows) - weight @ model.scores(rows), atol=1e-2)


def test_language_of_odd_rows(spark):
    rows = [(i, "la le li lo " * (i + 1), "aa", "c", 1) for i in range(20)] + [(i, "ka ke ki ko " * (i + 1), "bb", "c", 1) for i in range(20)]
    rows += [(None, "la le li", None, None, None), (None, "la le li", None, None, None), (50, "ki ko " * 400_000, None, "c", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    got = langid.identify(docs, langid.train(docs)).collect()
    assert [r.lang_pred for r in got if r.doc_id is None] == ["aa", "aa"] and [r.lang_pred for r in got if r.doc_id == 50] == ["bb"]
    assert docs.select(langid.held_out().alias("h")).filter("h IS NULL").count() == 0
    many = langid.train(docs, per_label=3)
    assert many.landmarks.shape[1] == 6
    with pytest.raises(ValueError, match="labels"):
        langid.train(docs, max_labels=1)


def test_media_round_trip_and_captions(spark):
    for payload in (b"\0" * 64, bytes(range(256)), b"x" * 65):
        assert media.samples(media.wave(payload)) == payload
    assert media.payload_of("") == (0, b"\0" * 64) and media.payload_of("é" * 32) == (64, "é".encode() * 32)
    digest = "0" * 64
    page = f'<p>one<figure><img src="sha256:{digest}" alt="alt"><figcaption>cap <b>tion</b></figcaption></figure>two<br>three<img src="x.png" alt="seen"><img>'
    got = [(i["kind"], i["text"], i["digest"], i["caption"]) for i in media.sequence_of(page)]
    assert got == [("text", "one", None, None), ("media", None, digest, "cap tion"), ("text", "two three", None, None), ("media", None, None, "seen")]
    assert media.sequence_of(None) == media.sequence_of("") == []
    rows = [(1, "ab"), (2, "ab"), (3, None), (4, ""), (5, "x" * 1000)]
    pages, payloads = media.documents_as_media(documents(spark, rows))
    items = media.resolve(media.parse_sequences(pages, "id", "html"), media.read_payloads(payloads)).filter("kind = 'media'").toPandas()
    assert len(items) == 5 and items.feature.notna().all() and items.digest.nunique() == 3
    with pytest.raises(Exception, match="digest"):
        media.read_payloads(spark.createDataFrame([("f" * 64, bytearray(media.wave(b"x")))], "digest string, media binary")).collect()


def test_media_stay_aligned_with_the_lines_around_them(spark):
    rnd = random.Random(9)
    texts = ["\n".join(" ".join(rnd.choices(["a", "<b>", "&amp;", "\"q'", "é", "", "  x"], k=rnd.randrange(4))) for _ in range(rnd.randrange(12))) for _ in range(60)]
    rows = [*enumerate(texts), (100, None), (101, "long line " * 200_000), (None, "no id"), (0, texts[0])]
    pages, payloads = media.documents_as_media(documents(spark, rows))
    items = media.resolve(media.parse_sequences(pages, "id", "html"), media.read_payloads(payloads)).toPandas()
    seen = 0
    for i, text in rows:
        mine = items[items.id.isna() if i is None else items.id == i].drop_duplicates("position").sort_values("position")
        lines = (text or "").split("\n")
        clean = [" ".join(x.split()) for x in lines]
        first = [x for x in clean[: len(lines) // 2] if x]
        expected = [*first, None, *(x for x in clean[len(lines) // 2 :] if x)]
        assert [t if isinstance(t, str) else None for t in mine.text] == expected and mine.position.tolist() == list(range(len(expected)))
        figure = mine[mine.kind == "media"].iloc[0]
        n, payload = media.payload_of(text)
        assert (figure.caption, figure.payload_sha256, figure.position) == (f"{n} bytes", hashlib.sha256(payload).hexdigest(), len(first))
        seen += len(mine)
    assert items[items.id == 0].shape[0] == 2 * items[items.id == 0].position.nunique()
    empty, nothing = media.documents_as_media(spark.createDataFrame([], DOCS))
    assert media.resolve(media.parse_sequences(empty, "id", "html"), media.read_payloads(nothing)).count() == 0


@pytest.mark.parametrize("rule", attribution.RULES)
@pytest.mark.parametrize("sections", ["fields", "lines"])
def test_attribution_equals_brute_force(spark, rule, sections):
    """Every token to sections, character by character."""
    rnd = random.Random(11)
    texts = ["".join(rnd.choices("abcde é日😀 \n", k=rnd.randrange(60))) for _ in range(25)] + [None, "", "\n\n", "word " * 20_000]
    rows = [*enumerate(texts), (None, "no id"), (3, texts[3])]
    encode = bpe.encoder(bpe.vocabulary_path())
    got = attribution.count_tokens(documents(spark, rows), ["lang", "text"], rule=rule, sections=sections).toPandas()
    for i, text in rows[:25] + rows[25:29]:
        whole = "oc\n" + (text or "")
        of_byte = [k for k, c in enumerate(whole) for _ in c.encode()]
        owner, bounds = [], []  # the section of each character
        for field, start, end in (("lang", 0, 3), ("text", 3, len(whole))):
            pieces = re.findall("[^\n]*\n|[^\n]+", whole[start:end]) if sections == "lines" and end > start else [whole[start:end]]
            for piece in pieces:
                owner += [len(bounds)] * len(piece)
                bounds.append(field)
        counts, at = [0.0] * len(bounds), 0
        for token in encode.tokenizer.encode(whole, add_special_tokens=False).ids:
            size = int(encode.byte_lengths[token])
            held = [owner[k] for k in range(of_byte[at], of_byte[at + size - 1] + 1)]
            at += size
            if rule == "start":
                counts[held[0]] += 1
            elif rule == "most":
                counts[max(sorted(set(held)), key=held.count)] += 1
            else:
                for k in held:
                    counts[k] += 1 / len(held)
        mine = got[got.id == i].drop_duplicates("section").sort_values("section")
        assert mine.field.tolist() == bounds and np.allclose(mine.n_tokens, counts), (i, text)
    assert len(got[got.id == 3]) == 2 * got[got.id == 3].section.nunique() and len(got[got.id.isna()])


PAGE = """<!doctype html><html><head><title>t</title><script>var a = "<p>no</p>";</script></head><body><header><h1>Site</h1></header>
<nav><a href=a>Home</a><a href=b>News</a></nav><div id="cookie-notice"><p>We use cookies on this site, as all sites do.</p></div>
<div class="content">{}</div><aside><p>Other stories that are long enough to look like text.</p></aside>
<div class="comments"><p>A reader thinks something about this article.</p></div><form><p>Name</p><input></form><footer>&copy; us</footer></body></html>"""
BODY = "<h1>Title &amp; more</h1><p>First paragraph with a <a href=x>link</a>\n and text.<p>Second &eacute; paragraph,<br>with a break.</p><ul><li>one item<li>two items</ul>"


@pytest.mark.parametrize("body", [BODY, f"<article>{BODY}</article>", f"<main><article>{BODY}</article></main>"])
def test_extraction(body):
    expected = "Title & more\nFirst paragraph with a link and text.\nSecond é paragraph, with a break.\none item\ntwo items"
    assert extraction.main_text(PAGE.format(body)) == expected


@pytest.mark.parametrize(("page", "text"), [(None, ""), ("", ""), ("a &lt; b", "a < b"), ("<p>a<p>b", "a\nb"), ("<nav>x</nav>", ""), ("<div" * 50, ""), ("<b>" * 3000 + "deep", "deep")])
def test_extraction_of_odd_pages(page, text):
    assert extraction.main_text(page) == text


ARTICLE = "<h1>T t</h1>" + "".join(f"<p>Paragraph {i} with a number of words in it, so that it has some weight.</p>" for i in range(4)) + "<p>Short.</p>"


@pytest.mark.parametrize(
    "page",
    [
        "<body class='single comments-open'><div>{}</div></body>", "<body><div class='content with-sidebar'>{}</div>", "<div class='legal-text'>{}</div>", "<article class='has-comments'>{}</article>",
        "<main><article>{}</article><section><h2>More stories</h2><ul><li><a href=a>Some other story</a><li><a href=b>And another one</a></ul></section></main>",
        "<div class='sidebar'>{}</div>", "<div><div class='section-header'>{}</div></div>", "<body><div id='header'><p>A site about all kinds of things.</p></div><div class='post-header'>{}</div>", "<div>{}<div class='comment-list'><div class='comment'><p>I think that this is quite wrong, and I have said so before.</p></div></div></div>",
        "<div id=page><div class='ad-container'>Buy this now, it is very good.</div><div><header>{}</header></div></div>",
    ],
)
def test_extraction_is_not_led_by_class_words(page):
    assert extraction.main_text(page.format(ARTICLE)) == "\n".join(re.findall(">([^<]+)<", ARTICLE))


def test_extraction_measures_equal_brute_force():
    rnd = random.Random(4)

    def tree(depth):
        tag = rnd.choice(["div", "p", "a", "b", "section", "ul", "li"])
        inner = "".join(rnd.choice(["word ", "more words here ", tree(depth - 1) if depth else "x"]) for _ in range(rnd.randrange(5)))
        return f"<{tag}>{inner}</{tag}>"

    def count(node):
        chars = sum(len(" ".join(c.split())) for c in node.children if isinstance(c, str))
        tags = links = link_tags = 0
        for child in node.children:
            if not isinstance(child, str):
                c, t, lc, lt = count(child)
                chars, tags, links, link_tags = chars + c, tags + t + (child.tag in extraction.BLOCK or child.tag == "a"), links + lc, link_tags + lt
        return (chars, tags, chars, link_tags + 1) if node.tag == "a" else (chars, tags, links, link_tags)

    for _ in range(200):
        root, nodes = extraction.parse("".join(tree(4) for _ in range(3)))
        density, sums, shares = extraction._measure(nodes, [True] * len(nodes))
        whole = count(root)
        for node in nodes:
            c, t, lc, lt = count(node)
            block = node.tag in extraction.BLOCK or node.parent is None
            assert density[node.index] == (extraction.composite(c, t, lc, lt, whole[2] / whole[0]) if c and block else 0)
            inner = [x for x in node.children if not isinstance(x, str)]
            expected = 0
            while inner:  # what inline elements hold counts as held by their block
                x = inner.pop()
                expected += density[x.index]
                inner += [y for y in x.children if not isinstance(y, str)] if x.tag not in extraction.BLOCK else []
            assert abs(sums[node.index] - (expected if block else 0)) < 1e-6
            assert shares[node.index] == (lc / c if c else 0)
        roots = extraction._roots(nodes, [True] * len(nodes))
        assert any(sums[i] == max(sums) or max(sums) == 0 or i == 0 for i in roots)


def test_extraction_of_many_rows(spark):
    long = "<article>" + "<p>A paragraph of a very long page.</p>" * 30_000 + "</article>"
    rows = [(1, "u", ARTICLE, "clash"), (1, "u", ARTICLE, "clash"), (None, None, None, None), (2, "v", long, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = extraction.extract_pages(pages).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == [(0, 0), (1, len(extraction.main_text(ARTICLE))), (1, len(extraction.main_text(ARTICLE))), (2, (len("A paragraph of a very long page.") + 1) * 30_000 - 1)]


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (7, 7), (None, 1), (10, 11), (11, 12), (12, 13), (13, 10)] + [(100, 100 + i) for i in range(1, 300)]
    frame = spark.createDataFrame(edges, "u long, v long")
    got = {r.node: r.component for r in graph.components(frame, Scratch(spark, "test")).collect()}
    expected = {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 10: 10, 11: 10, 12: 10, 13: 10} | {100 + i: 100 for i in range(300)}
    assert got == expected


def test_url_verdicts_propagate_over_redirects(spark):
    rows = [
        (1, "http://WWW.Site.net/x?q", None), (2, "https://example.net/en/a", ""), (3, "http://alias.org/a", '<link rel="canonical" href="http://www.site.net/x?q">'),
        (4, "http://other.org/b", "<meta http-equiv=refresh content='0; url=http://alias.org/a'>"), (5, None, None), (6, "no scheme", None), (7, "http://site.net", None),
        (8, "http://both.org/1", '<link href="//www.site.net/x?q" rel=canonical>'), (9, "http://good.org/fr/x", '<link rel=canonical href="/fr/y">'), (10, "http://good.org/de/", '<link rel=canonical href="/fr/x">'),
    ]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(frame).collect()}
    assert got[1] == ("www.site.net", "/x", "net/", "block")
    assert got[2] == ("example.net", "/en/a", "example.net/en/", "allow")
    assert got[3][2:] == got[4][2:] == got[8][2:] == (None, "block")
    assert got[5] == got[6] == ("", "", None, "allow")
    assert got[7] == ("site.net", "", None, "allow")  # a url without a path does not start with the rule's
    assert got[9][2:] == ("org/fr/", "allow") and got[10][2:] == (None, "allow")


@pytest.mark.parametrize(
    ("html", "target"),
    [
        ("<link rel='nofollow canonical' href='../b/./c?x=1&amp;y=2#f'>", "h.org/b/c?x=1&y=2"), ("<link title='a > b' href=up/.. rel=Canonical>", "h.org/a/"),
        ("<!-- <link rel=canonical href=/no> --><script>'<link rel=canonical href=/no>'</script>", None), ("<link rel=canonical href='?q'>", "h.org/a/p?q"),
        ("<link rel=alternate href=/no><link rel=canonical href=/yes>", "h.org/yes"), ("<META content='3;URL=//other.org/z' http-equiv='Refresh'>", "other.org/z"),
        ("<link rel=canonical href='mailto:x@y'>", None), ("<link rel=canonical href='/../../k'>", "h.org/k"), (None, None), ("canonical refresh", None),
    ],
)
def test_edges_of_pages(spark, html, target):
    frame = spark.createDataFrame([("http://H.org/a/p?z", html)], "url string, html string")
    got = [r.v for r in urls.page_edges(frame, "url", "html").select(urls.node_of(F.col("target")).alias("v")).collect()]
    assert got == ([target] if target else [])


def test_verdicts_over_chains_stars_and_a_hot_node(spark):
    """Propagation against brute force: random rules of urls, chains, stars, and a node with a third of all edges."""
    rnd = random.Random(12)
    names = [f"http://{rnd.choice(['a.net', 'b.org', 'c.example.com', 'd.info'])}/{rnd.choice(['fr/', 'de/', 'en/', 'x/'])}{i}" for i in range(400)]
    edges = [(names[i], names[i + 1]) for i in range(0, 60)] + [(names[100], names[i]) for i in range(101, 160)] + [(names[i], names[200]) for i in range(201, 300)]
    edges += [tuple(rnd.sample(names[300:], 2)) for _ in range(40)] + edges[:20] + [(names[5], names[5]), (None, names[1]), ("no scheme", names[2])]
    rows = [(i, u, None, "clash") for i, u in enumerate(names)] + [(900, names[7], None, "clash"), (901, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, rule string")
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge_urls(pages, edges=spark.createDataFrame(edges, "source string, target string")).collect()}

    def own(url):
        host, path = url[7:].split("/", 1)
        fits = [(len(h + p), v, h + p) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and ("/" + path).startswith(p)]
        return max(fits)[1:] if fits else (None, None)

    group = {u: u for u in names}
    for _ in range(len(names)):
        before = dict(group)
        for a, b in edges:
            if a in group and b in group:
                group[a] = group[b] = min(group[a], group[b])
        if group == before:
            break
    for i, url, *_ in rows:
        if url is None:
            assert got[i] == (None, "allow")
            continue
        verdict, rule = own(url)
        fates = {own(u)[0] for u in names if group[u] == group[url]}
        assert got[i] == (rule, verdict or ("block" if "block" in fates and "allow" not in fates else "allow"))


def test_neighbours_recall_and_ties(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 16)).astype(np.float32)
    x[300:330] = x[299]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] + [1.0] * 15), (1003, [None] + [1.0] * 15), (1004, [1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = neighbours.nearest(frame, F.col("id") % 50 == 0).toPandas()
    assert not set(got.vec_id) & {1000, 1001, 1002, 1003, 1004}
    hits = 0
    for q in range(0, 600, 50):
        scores = neighbours.cosine(x[q], x)
        order = [i for i in sorted(range(600), key=lambda i: (-scores[i], i)) if i != q][:5]
        mine = got[got.query_id == q].sort_values("rank")
        assert mine["rank"].tolist() == [1, 2, 3, 4, 5]
        assert all(abs(scores[v] - s) < 1e-12 for v, s in zip(mine.vec_id, mine.score))
        hits += len(set(order) & set(mine.vec_id))
        if q == 300:
            assert mine.vec_id.tolist() == order
    assert hits / 60 >= 0.9


def test_recall_over_several_shards(spark, monkeypatch):
    """Against brute force on four shards and more, of clustered vectors with clashing columns."""
    monkeypatch.setattr(neighbours, "SHARD_ROWS", 1000)
    monkeypatch.setattr(neighbours, "SHARD_BYTES", 1000)
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(12, 24))[rng.integers(0, 12, 4500)] + 0.6 * rng.normal(size=(4500, 24))).astype(np.float32)
    frame = spark.createDataFrame([(i, v.tolist(), 1, 0.5) for i, v in enumerate(x)], "vec_id long, embedding array<float>, rank int, score double").repartition(4)
    got = neighbours.nearest(frame, F.col("id") % 50 == 0).toPandas()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 4500, 50):
        scores = unit @ unit[q]
        scores[q] = -2
        hits += len(set(np.argsort(-scores)[:5].tolist()) & set(got[got.query_id == q].vec_id))
    assert len(got) == 450 and hits / 450 >= 0.95


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    shared = "passatge " + " ".join(words(9, 60))
    rows = corpus() + [(50, shared + " a"), (51, "b " + shared + " " + " ".join(words(30, 80)))]
    docs = spark.createDataFrame([(i, t, "oc" if i % 2 else None, "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, kept string, n_chars long")
    docs.write.parquet(str(tmp_path / "0"))
    docs = spark.read.parquet(str(tmp_path / "0"))
    texts = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.columns
        stage(spark, docs, "").write.parquet(str(tmp_path / str(k + 1)))
        docs = spark.read.parquet(str(tmp_path / str(k + 1)))
        if k < 3:
            assert docs.columns == before
            texts.append({r.doc_id: r.text for r in docs.collect()})
    assert set(texts[0]) == {i for i, t in rows if t and t.strip()}
    expected = brute_components([(i, t) for i, t in rows if i in texts[0]])
    assert len(texts[1]) == len({c for _, c in expected.values()})
    assert texts[2].keys() == texts[1].keys() and shared not in texts[2][51] and texts[2][51].endswith(" ".join(words(30, 80)))
    assert pd.DataFrame(docs.collect(), columns=docs.columns).groupby("sequence_id").length.sum().max() <= 1024


def test_pipeline_of_empty_tables_and_null_ids(spark, tmp_path):
    """The whole run over no rows, and over null ids, repeated rows and clashing columns."""
    import corpus_pipeline
    from lexiforge.llm import common

    schema = "doc_id long, text string, lang string, source string, n_chars long, id string, rank int, kept string"
    rows = [(None, "lo can manja lo pan de l'ostal", None, "s", 30, "x", 1, None), (None, "lo can manja lo pan de l'ostal", None, "s", 30, "x", 1, None), (3, None, "oc", None, None, None, None, None), (4, "123", "oc", "s", 3, None, None, "k")]
    for name, held in (("none", []), ("some", rows)):
        folder = tmp_path / name
        spark.createDataFrame(held, schema).write.parquet(str(folder / "documents.parquet"))
        before = len(common.opened)
        got = corpus_pipeline.run(spark, str(folder)).collect()
        assert len(common.opened) == before + 1 and len({r.doc_id for r in got}) == len(got) == len(held[:1])


def test_jaccard_and_packing_of_odd_rows(spark):
    """Null ids, repeated rows, very long texts, clashing columns."""
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(None, "un dos tres quatre cinc sèis"), (7, "un dos tres quatre cinc sèis"), (7, "un dos tres quatre cinc sèis"), (8, long), (9, long + " fin"), (10, None), (None, None)]
    docs = spark.createDataFrame([(i, t, 5, 6, b"x") for i, t in rows], "doc_id long, text string, component_id int, n int, tokens binary").repartition(3)
    got = sorted(((r.doc_id or 0, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(0, 2, 7), (7, 2, 7), (7, 2, 7), (8, 59_996, 8), (9, 59_997, 8), (10, 0, 10), (0, 0, None)], key=str)
    clash = docs.withColumnRenamed("n", "length").withColumnRenamed("component_id", "sequence_id")
    packed = packing.pack_documents(clash).toPandas()
    assert packed[packed.id.isna()].length.sum() == packed[packed.id == 7].length.sum() // 2 + 1
    assert packed[packed.id == 8].length.sum() == packed[packed.id == 8].doc_tokens.iloc[0] and packed.groupby("sequence_id").length.sum().max() == 1024


def test_hot_tokens_stay_in_their_shard(spark):
    """A line that every text has is counted for its shard at once; components are those of brute force."""
    rnd = random.Random(21)
    line = " ".join(words(77, 12))
    rows = []
    for i in range(160):
        own = " ".join(f"{i}q{rnd.randrange(10**6)}" for _ in range(rnd.choice([1, 2, 30])))
        rows.append((i, f"{line} {own}"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(documents(spark, rows).coalesce(1)).collect()}
    assert got == brute_components(rows)
