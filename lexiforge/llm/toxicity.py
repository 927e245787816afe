"""Toxicity of texts behind leetspeak, spacing and repetition.

A noisy channel: what was meant is words of letters, under a character language model that is counted over the whole
corpus; what is seen may have digits and signs for letters, single letters set apart, and letters repeated. The
readings of a piece of text form a lattice, whose likeliest path a Viterbi search finds. A text is scored by the
words that are restored in this way: by whole words and their beginnings, present or not, in a logistic regression.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import Scratch, ship_code, tidy
from .langid import held_out

#: Symbols of the language model: 0 between words, 1-26 letters without their accents, other letters, digits.
LETTERS, OTHER, DIGIT, SYMBOLS = 26, 27, 28, 29
#: Symbols before one that its probability depends on.
CONTEXT = 3
_CONTEXTS = SYMBOLS**CONTEXT

#: Letters that a digit or sign may stand for.
READINGS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "£": "l", "¡": "i", "§": "s",
}
SEPARATORS = " .-_*·"
#: The channel: minus log probabilities of a digit or sign for a letter, a digit that is one, a separator beside one
#: single letter that means nothing, a letter written twice, each further letter of a longer repetition, and words
#: that end at a separator between two single letters or at a sign inside a piece.
LEET, DIGIT_KEPT, SPACED, DOUBLED, REPEATED, PARTED = 1.0, 1.0, 1.5, 3.0, 0.3, 1.5

#: Labelled texts of each class that the regression is fitted on, at most; features that it has, at most, and how
#: many standard errors their shares must differ between the classes by.
TRAIN_PER_CLASS = 4000
FEATURES = 512
LEAST_ERRORS = 4.0
RIDGE = 0.01
#: Lengths of the beginnings of words that are features.
BEGINNINGS = (3, 4, 5, 6)
#: From this score on a text is called toxic.
THRESHOLD = 0.3

_CACHED = 400_000
_ROWS = 512


def _symbol(c: str) -> int:
    if c.isdigit():
        return DIGIT
    if not c.isalpha():
        return 0
    base = unicodedata.normalize("NFKD", c)[0].lower()
    return ord(base) - 96 if "a" <= base <= "z" else OTHER


#: Symbols of the first characters; all further ones are other letters.
_TABLE = np.array([_symbol(chr(i)) for i in range(0x3000)] + [OTHER], np.uint8)
_KNOWN = _TABLE.tolist()


def count_grams(tokens: Counter) -> np.ndarray:
    """How often each symbol follows each context, in words of the counted tokens. A word starts with a context of zeros."""
    counts = np.zeros(_CONTEXTS * SYMBOLS, np.int64)
    if not tokens:
        return counts
    codes = np.frombuffer((" " + " ".join(tokens) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    s = _TABLE[np.minimum(codes, len(_TABLE) - 1)].astype(np.int64)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1
    weights = np.concatenate([[0], np.repeat(np.fromiter(tokens.values(), np.int64, len(tokens)), sizes)])
    before = [np.concatenate([np.zeros(k, np.int64), s[:-k]]) for k in range(1, CONTEXT + 1)]
    for k in range(1, CONTEXT):  # what lies before a word's start does not count
        before[k] = np.where(before[k - 1] == 0, 0, before[k])
    inside = (s > 0) | (before[0] > 0)
    context = np.zeros(len(s), np.int64)
    for k in range(CONTEXT - 1, -1, -1):
        context = context * SYMBOLS + before[k]
    found = np.bincount((context * SYMBOLS + s)[inside], weights=weights[inside].astype(np.float64), minlength=len(counts))
    return counts + found.astype(np.int64)


def log_probabilities(counts: np.ndarray) -> np.ndarray:
    """Of every symbol after every context, interpolated with shorter contexts in the manner of Witten and Bell."""
    counts = counts.reshape((SYMBOLS,) * (CONTEXT + 1)).astype(np.float64)
    p = np.full(SYMBOLS, 1.0 / SYMBOLS)
    for order in range(CONTEXT + 1):
        own = counts.sum(axis=tuple(range(CONTEXT - order)))
        total, kinds = own.sum(axis=-1, keepdims=True), (own > 0).sum(axis=-1, keepdims=True)
        p = np.where(total > 0, (own + kinds * p) / np.maximum(total + kinds, 1), p)
    return np.log(p).astype(np.float32).ravel()


def language_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The character model of the whole corpus. The driver gets one count for each string of CONTEXT + 1 symbols at
    most, however large the corpus is."""
    ship_code(docs.sparkSession)

    def run(batches):
        counts = np.zeros(_CONTEXTS * SYMBOLS, np.int64)
        for batch in batches:
            texts = batch.column(0)
            for at in range(0, len(texts), _ROWS):
                tokens: Counter = Counter()
                for text in texts.slice(at, _ROWS).to_pylist():
                    tokens.update((text or "").lower().split())
                counts += count_grams(tokens)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(counts[held])], names=["gram", "n"])

    found = docs.select(text_col).mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(_CONTEXTS * SYMBOLS, np.int64)
    counts[found["gram"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return log_probabilities(counts)


_LEET = re.escape("".join(READINGS))
#: Pieces that are decoded by themselves: everything but letters, digits, signs with readings and separators ends one.
_PIECE = re.compile(rf"(?:[^\W_]|[{_LEET}{re.escape(SEPARATORS)}])+")
_LETTER = re.compile(r"[^\W\d_]")
_TWICE = re.compile(r"(.)\1+")
_SINGLES = re.compile(rb"\x01{3,}")


class Decoder:
    """Restores what was meant, by the language model ``log_p``."""

    def __init__(self, log_p: np.ndarray):
        self._log_p = memoryview(np.ascontiguousarray(log_p, np.float32))
        self._words: dict[str, tuple[str, ...]] = {}

    def likeliest(self, seen: str) -> str:
        """The likeliest path through the readings of ``seen``; a space stands between words."""
        log_p, n = self._log_p, len(seen)
        plain = [READINGS[c][0] if c in READINGS else c for c in seen]
        run = [1] * n  # how long the repetition around a place is
        start = 0
        for i in range(1, n + 1):
            if i == n or plain[i] != plain[start]:
                run[start:i] = [i - start] * (i - start)
                start = i
        apart = [c in SEPARATORS for c in seen]
        states: dict[int, float] = {0: 0.0}
        steps: list[dict[int, tuple[int, str]]] = []
        for i, c in enumerate(seen):
            after: dict[int, float] = {}
            step: dict[int, tuple[int, str]] = {}
            readings = READINGS.get(c, "")
            if apart[i]:
                says = ()
                # a separator may mean nothing if a single letter stands beside it
                between = 0 < i < n - 1 and not apart[i - 1] and not apart[i + 1]
                singles = between * ((i == 1 or apart[i - 2]) + (i == n - 2 or apart[i + 2]))
                parted = PARTED if singles == 2 else 0.0
            else:
                singles, parted = 0, PARTED if 0 < i < n - 1 else 0.0
                says = [(x, _KNOWN[ord(x)], LEET) for x in readings]
                symbol = _KNOWN[min(ord(c), 0x3000)]
                if symbol:
                    says.append((c, symbol, DIGIT_KEPT if readings else 0.0))
                elif not readings:
                    says.append((c, OTHER, 0.0))
            drops = REPEATED if run[i] > 2 else DOUBLED
            repeats = i > 0 and plain[i] == plain[i - 1] and not apart[i]
            parts = apart[i] or (bool(readings) and not c.isdigit())
            for context, cost in states.items():
                for letter, symbol, price in says:
                    total = cost + price - log_p[context * SYMBOLS + symbol]
                    then = (context * SYMBOLS + symbol) % _CONTEXTS
                    if total < after.get(then, np.inf):
                        after[then], step[then] = total, (context, letter)
                if parts:
                    total = cost + parted - (log_p[context * SYMBOLS] if context else 0.0)
                    if total < after.get(0, np.inf):
                        after[0], step[0] = total, (context, " ")
                if singles and (total := cost + (SPACED if singles == 1 else 0.0)) < after.get(context, np.inf):
                    after[context], step[context] = total, (context, "")
                if repeats and any(context % SYMBOLS == symbol for _, symbol, _ in says) and cost + drops < after.get(context, np.inf):
                    after[context], step[context] = cost + drops, (context, "")
            steps.append(step)
            states = after
        context = min(states, key=lambda k: states[k] - (log_p[k * SYMBOLS] if k else 0.0))
        out = []
        for step in reversed(steps):
            context, letter = step[context]
            out.append(letter)
        return " ".join("".join(reversed(out)).split())

    def _of_letters(self, word: str) -> str:
        """``likeliest`` for a word of letters. A letter that is doubled, far enough from the next such one, is decided by
        the symbols up to where both readings have the same context again."""
        runs = [m.span() for m in _TWICE.finditer(word)]
        if not runs:
            return word
        if any(b - a > 2 for a, b in runs) or any(b[0] - a[1] < CONTEXT for a, b in zip(runs, runs[1:])):
            return self.likeliest(word)
        log_p, symbols, dropped = self._log_p, [_KNOWN[min(ord(c), 0x3000)] for c in word] + [0], []
        for at, after in runs:
            context = 0
            for symbol in symbols[max(0, after - 1 - CONTEXT) : after - 1]:
                context = (context * SYMBOLS + symbol) % _CONTEXTS
            gain, kept, gone = -DOUBLED, context * SYMBOLS + symbols[at], context * SYMBOLS
            gain -= log_p[kept]
            kept = kept % _CONTEXTS * SYMBOLS
            for symbol in symbols[after : after + CONTEXT]:
                gain += log_p[gone + symbol] - log_p[kept + symbol]
                gone, kept = (gone + symbol) % _CONTEXTS * SYMBOLS, (kept + symbol) % _CONTEXTS * SYMBOLS
            if gain > 0:
                dropped.append(at)
        return "".join(c for k, c in enumerate(word) if k not in dropped) if dropped else word

    def decode(self, token: str) -> tuple[str, ...]:
        """The words that a token of lower case, or a row of single letters, was meant as."""
        if token.isalpha():
            return (self._of_letters(token),)
        found: list[str] = []
        for piece in _PIECE.findall(token):
            piece = piece.strip(SEPARATORS)
            if piece.isalpha():
                found.append(self._of_letters(piece))
            elif _LETTER.search(piece):
                found += self.likeliest(piece).split()
        return tuple(found)

    def words(self, token: str) -> tuple[str, ...]:
        """``decode``, remembered for short tokens."""
        known = self._words.get(token)
        if known is None:
            known = self.decode(token)
            if len(self._words) >= _CACHED:
                self._words.clear()
            if len(token) < 100:
                self._words[token] = known
        return known

    @staticmethod
    def tokens(text: str | None) -> list[str]:
        """What is decoded by itself, in order: words between white space, and rows of single letters joined to one."""
        tokens = (text or "").lower().split()
        singles = bytes([len(t) == 1 for t in tokens])
        if b"\1\1\1" not in singles:
            return tokens
        out, at = [], 0
        for found in _SINGLES.finditer(singles):
            out += tokens[at : found.start()]
            out.append(" ".join(tokens[found.start() : found.end()]))
            at = found.end()
        return out + tokens[at:]

    def restore(self, text: str | None) -> str:
        return " ".join(w for token in self.tokens(text) for w in self.words(token))


def features(word: str) -> list[str]:
    """A word, with a mark at its end, and its beginnings."""
    return [word + "$", *(word[:k] for k in BEGINNINGS if len(word) >= k)]


@dataclass
class Model:
    """log_p: of the language model; weights: of the features."""

    log_p: np.ndarray
    weights: dict[str, float]
    bias: float


class Scorer:
    def __init__(self, model: Model):
        self.model, self.decoder = model, Decoder(model.log_p)
        self._telling: dict[str, tuple[str, ...]] = {}
        self._silent: set[str] = set()
        # how words with a feature start
        self._starts = {f[: BEGINNINGS[0]] for f in model.weights}

    def features(self, token: str) -> tuple[str, ...]:
        """Of the words that a token was meant as, what the model has a weight for."""
        weights, starts, first = self.model.weights, self._starts, BEGINNINGS[0]
        return tuple(f for w in self.decoder.decode(token) if (w[:first] if len(w) >= first else (w + "$")[:first]) in starts for f in features(w) if f in weights)

    def score(self, text: str | None) -> float:
        present: set[str] = set()
        for token in set(self.decoder.tokens(text)) - self._silent:
            found = self._telling.get(token)
            if found is None:
                found = self.features(token)
                if len(token) < 100:
                    if found:
                        self._telling[token] = found
                    else:
                        self._silent.add(token)
            present.update(found)
        if len(self._silent) > _CACHED or len(self._telling) > _CACHED:
            self._silent.clear()
            self._telling.clear()
        z = self.model.bias + sum(self.model.weights[f] for f in sorted(present))
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def fit(rows: np.ndarray, labels: np.ndarray, weight: np.ndarray, ridge: float = RIDGE) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression of presence bits, by Newton's method; the bias is not shrunk."""
    x = np.concatenate([rows.astype(np.float64), np.ones((len(rows), 1))], axis=1)
    shrink = np.full(x.shape[1], ridge)
    shrink[-1] = 1e-6
    w = np.zeros(x.shape[1])
    loss = lambda w: float((weight * np.logaddexp(0, np.where(labels > 0, -1, 1) * (x @ w))).sum() + (shrink * w * w).sum() / 2)
    now = loss(w)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - labels)) + shrink * w
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(shrink)
        step, size = np.linalg.solve(bend, slope), 1.0
        while (then := loss(w - size * step)) > now and size > 1e-6:
            size /= 2
        done = now - then < 1e-6 * max(now, 1)
        if then <= now:
            w, now = w - size * step, then
        if done:
            break
    return w[:-1], float(w[-1])


def _chosen(labels: DataFrame, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """(id, label) of at most ``per_class`` rows of each label that come first by a hash of the id, and how many there are."""
    counts = {r["label"]: r["n"] for r in labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    whole = (1 << 63) - 1
    rank = F.xxhash64("id", F.lit(SYMBOLS)).bitwiseAND(F.lit(whole))
    # twice the rows wanted, so that enough remain and few are brought together
    bound = {label: whole if n <= 2 * (per_class + 64) else int(2 * (per_class + 64) / n * whole) for label, n in counts.items()}
    limit = F.when(F.col("label") == 1, F.lit(bound.get(1, 0))).otherwise(F.lit(bound.get(0, 0)))
    first = F.row_number().over(Window.partitionBy("label").orderBy("rank", "id"))
    return labels.withColumn("rank", rank).filter(F.col("rank") <= limit).withColumn("place", first).filter(F.col("place") <= per_class).select("id", "label"), counts


def train(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic", per_class: int = TRAIN_PER_CLASS) -> Model:
    """The language model of all docs, and a regression fitted on a bounded sample of the labelled ones.

    Labels are 1 or 0; rows with another label, a null one or a null id teach nothing, as do ids without a document.
    Of each class the ``per_class`` rows that come first by a hash of their id are taken, weighted as the classes
    occur. An id with two labels or two documents teaches each of them. If one class is missing, all texts get the
    share of label 1 (0 without labels). Other columns are not looked at.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    log_p = language_model(docs, text_col)
    held = spark.sparkContext.broadcast(log_p)  # SYMBOLS ** (CONTEXT + 1) numbers
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter(F.col("id").isNotNull() & F.col("label").isin(0, 1))
    chosen, counts = _chosen(known, per_class)
    if not counts.get(0) or not counts.get(1):
        return Model(log_p, {}, 40.0 if counts.get(1) else -40.0)

    def run(batches):
        decoder = Decoder(held.value)
        for batch in batches:
            found = [sorted({f for token in set(decoder.tokens(t)) for w in decoder.words(token) for f in features(w)}) for t in batch["text"]]
            yield pd.DataFrame({"label": batch["label"], "features": found})

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").select("label", "text")
    sample = scratch.store(texts.repartition(spark.sparkContext.defaultParallelism).mapInPandas(run, "label int, features array<string>"), "sample", F.sum("label").alias("ones"))
    ones = sample.seen["ones"] or 0
    zeros = sample.seen["n_rows"] - ones
    if not ones or not zeros:
        return Model(log_p, {}, 40.0 if ones else -40.0)
    by_feature = sample.select("label", F.explode("features").alias("feature")).groupBy("feature").agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b"))
    share = (F.col("a") + F.col("b") + 1) / (ones + zeros + 2)
    errors = F.abs(F.col("a") / ones - F.col("b") / zeros) / F.sqrt(share * (1 - share) * (1 / ones + 1 / zeros))
    best = by_feature.withColumn("errors", errors).filter((F.col("a") + F.col("b") > 1) & (F.col("errors") >= LEAST_ERRORS)).orderBy(F.desc("errors"), "feature").limit(FEATURES)
    picked = sorted(r["feature"] for r in best.select("feature").collect())
    present = F.array_intersect("features", F.array(*map(F.lit, picked))) if picked else F.array().cast("array<string>")
    # rows alike are one row with a weight
    got = sample.select("label", F.array_sort(present).alias("present")).groupBy("label", "present").agg(F.count(F.lit(1)).alias("n")).orderBy("label", "present").collect()
    place = {f: k for k, f in enumerate(picked)}
    rows, y = np.zeros((len(got), len(picked)), np.float32), np.array([r["label"] for r in got], np.float64)
    for row, r in zip(rows, got):
        row[[place[f] for f in r["present"]]] = 1
    # classes weigh as they occur, however many rows of each are in the sample
    scale = {1: counts[1] / (counts[0] + counts[1]) * (ones + zeros) / ones, 0: counts[0] / (counts[0] + counts[1]) * (ones + zeros) / zeros}
    w, bias = fit(rows, y, np.array([r["n"] * scale[r["label"]] for r in got]))
    scratch.close()
    return Model(log_p, {f: float(w[k]) for f, k in place.items()}, bias)


def _with_column(docs: DataFrame, name: str, kind: str, arrow: pa.DataType, text_col: str, make) -> DataFrame:
    """docs with a column that ``make()`` computes from texts; a column of that name is replaced."""
    ship_code(docs.sparkSession)
    kept = [c for c in docs.columns if c != name]

    def run(batches):
        one = make()
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(at, _ROWS)
                values = pa.array([one(t) for t in batch.column(text_col).to_pylist()], arrow)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), values], names=[*kept, name])
        tidy()

    return docs.mapInArrow(run, StructType([*docs.select(*kept).schema, *StructType().add(name, kind)]))


def restore(docs: DataFrame, log_p: np.ndarray, text_col: str = "text") -> DataFrame:
    """Add the column ``restored``: the words of each text in lower case as they were meant, joined by spaces.

    A null text or one without a letter gives an empty string. Whole texts are read. Readings that are equally
    likely: the first in the order of READINGS. Repeated rows get the same answer.
    """
    held = docs.sparkSession.sparkContext.broadcast(log_p)
    return _with_column(docs, "restored", "string", pa.string(), text_col, lambda: Decoder(held.value).restore)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Add the column ``toxicity`` (0 to 1) to every row.

    A null or empty text, and one without a letter, gets the score of a text without features. Whole texts are read,
    however long. Repeated rows get the same score, an empty table gives no rows. A column of that name is replaced;
    all others pass through unchanged.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded: the language model, FEATURES weights
    return _with_column(docs, "toxicity", "double", pa.float64(), text_col, lambda: Scorer(held.value).score)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    found = score(docs, train(docs, labels.filter(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"))
