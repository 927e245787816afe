"""Evaluation: n-gram overlap, paired bootstrap, perplexity, preferences."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import exprs as X
from ..functions.shipping import ship_code
from . import sampling

BETA2 = 4.0
CHAR_ORDERS, WORD_ORDERS = 6, 2
#: Statistics of that many lines (about 400 bytes each) are sent to all executors; of more, they are joined by a shuffle.
BROADCAST_LINES = 100_000


def padded_bigrams(c) -> Column:
    """Character pairs of ^word$, lower-cased; none for the empty word."""
    marked = F.concat(F.lit("^"), F.lower(X.col(c)), F.lit("$"))
    return F.when(F.length(X.col(c)) > 0, F.transform(F.sequence(F.lit(1), F.length(marked) - 1), lambda i: F.substr(marked, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))


def bigram_cosine(a, b) -> Column:
    """Cosine of the bigram counts of two words: row-local, no shuffle.

    Of a sorted array of bigrams, the sum of squared counts is twice the number of equal pairs plus its length;
    a run is found by its ends, so the work follows the length, not its square.
    """
    left, right = F.array_sort(padded_bigrams(a)), F.array_sort(padded_bigrams(b))

    def counts(items):  # gram -> count, in one pass over the sorted array
        start = F.struct(F.lit("").alias("last"), F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("squares"))
        step = lambda acc, x: F.struct(
            x.alias("last"),
            F.when(acc["last"] == x, acc["run"] + 1).otherwise(F.lit(1).cast("long")).alias("run"),
            (acc["squares"] + F.when(acc["last"] == x, 2 * acc["run"] + 1).otherwise(F.lit(1).cast("long"))).alias("squares"),
        )
        return F.aggregate(items, start, step)["squares"].cast("double")

    # |x + y|^2 = |x|^2 + |y|^2 + 2 x.y, where x + y counts the grams of both
    both = counts(F.array_sort(F.concat(left, right)))
    x, y = counts(left), counts(right)
    norms = F.sqrt(x) * F.sqrt(y)
    return F.when(norms > 0, (both - x - y) / 2 / norms).otherwise(0.0)


#: White space as Unicode has it; characters that numpy counts at a time.
_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_UNITS = 1 << 20


def overlap_counts(hypotheses: list[str], references: list[str]) -> dict[str, np.ndarray]:
    """order -> rows (hyp, ref, match) for each pair of texts: n-grams of either side, and clipped common ones.

    Grams get numbers within their pair, by their shorter gram and last unit: exact, without hashing, and all
    pairs of a block are counted in one sort for each order.
    """
    n_pairs = len(hypotheses)
    out = {}
    for kind, most in (("c", CHAR_ORDERS), ("w", WORD_ORDERS)):
        names: dict[str, int] = {}
        sides = []
        for texts in (hypotheses, references):
            if kind == "c":
                sides.append([np.frombuffer(_SPACE.sub("", t).encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts])
            else:
                sides.append([np.array([names.setdefault(w, len(names)) for w in _SPACE.split(t) if w], np.uint32) for t in texts])
        parts = sides[0] + sides[1]
        lengths = np.array([len(p) for p in parts], np.int64)
        units = np.concatenate(parts).astype(np.int64) if len(parts) else np.zeros(0, np.int64)
        text = np.repeat(np.arange(2 * n_pairs), lengths)
        left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(units))  # units from here to the end of the text
        base = int(units.max(initial=0)) + 1
        pair, is_ref = text % max(n_pairs, 1), text >= n_pairs
        number = pair.copy()  # of the gram so far, within its pair
        for n in range(1, most + 1):
            at = np.flatnonzero(left >= n)
            found, gram = np.unique(number[at] * base + units[at + n - 1], return_inverse=True)
            held = np.bincount(gram[~is_ref[at]], minlength=len(found)), np.bincount(gram[is_ref[at]], minlength=len(found))
            owner = np.zeros(len(found), np.int64)
            owner[gram] = pair[at]
            number[at] = gram
            counts = [np.bincount(owner, weights=c, minlength=n_pairs) for c in (*held, np.minimum(*held))]
            out[f"{kind}{n}"] = np.stack(counts, axis=1).astype(np.int64)
    return out


def chrf_stats(pairs: DataFrame, keys: list[str], hypothesis: str, reference: str) -> DataFrame:
    """Sufficient statistics of each sentence and order: hyp, ref, match (clipped counts). Null texts are empty;
    orders without grams on either side have no row. keys must be unique.

    Counting stays within the row: Arrow batches go to numpy, and eight small rows come back, where exploded
    n-grams would be some sixteen rows for each character.
    """
    ship_code(pairs.sparkSession)
    narrow = pairs.select(*keys, F.col(hypothesis).alias("_hyp"), F.col(reference).alias("_ref"))
    schema = StructType([*narrow.select(*keys).schema, *StructType.fromDDL("order string, hyp long, ref long, match long")])

    def run(batches):
        for batch in batches:
            sizes = (batch["_hyp"].str.len().fillna(0) + batch["_ref"].str.len().fillna(0)).cumsum()
            for _, part in batch.groupby(sizes // _UNITS):
                hyp, ref = ([t if isinstance(t, str) else "" for t in part[c]] for c in ("_hyp", "_ref"))
                for order, counts in overlap_counts(hyp, ref).items():
                    found = part[keys].assign(order=order, hyp=counts[:, 0], ref=counts[:, 1], match=counts[:, 2])
                    yield found[counts[:, :2].any(axis=1)]

    return narrow.mapInPandas(run, schema)


def chrf_score(stats: DataFrame, keys: list[str]) -> DataFrame:
    """chrF++ (0 to 100) of summed statistics: precision and recall averaged over the orders that both sides
    have, then F with recall weighing twice; 0 where nothing is shared."""
    summed = stats.groupBy(*keys, "order").agg(F.sum("hyp").alias("hyp"), F.sum("ref").alias("ref"), F.sum("match").alias("match"))
    usable = summed.filter("hyp > 0 AND ref > 0")
    means = usable.groupBy(*keys).agg(F.avg(F.col("match") / F.col("hyp")).alias("p"), F.avg(F.col("match") / F.col("ref")).alias("r"))
    f = (1 + BETA2) * F.col("p") * F.col("r") / (BETA2 * F.col("p") + F.col("r"))
    return means.select(*keys, F.when(F.col("p") + F.col("r") > 0, 100 * f).otherwise(0.0).alias("chrf"))


def paired_bootstrap(both: DataFrame, line: str, n_lines: int, samples: int, seed) -> DataFrame:
    """One row: observed difference right - left, its 95 % interval and two-sided p value.

    both: chrf_stats of the sides left and right, by side and line number from 0. Samples draw line numbers by hash, the same for
    both systems; only statistics are summed again, in one row a line, n-grams are never extracted twice.
    """
    sides, orders, counts = ("left", "right"), [f"{kind}{n}" for kind, most in (("c", CHAR_ORDERS), ("w", WORD_ORDERS)) for n in range(1, most + 1)], ("hyp", "ref", "match")
    cells = [(side, order, c) for side in sides for order in orders for c in counts]
    name = "_".join
    wide = both.groupBy(line).agg(*(F.coalesce(F.sum(F.when((F.col("side") == x[0]) & (F.col("order") == x[1]), F.col(x[2]))), F.lit(0)).alias(name(x)) for x in cells))
    if n_lines <= BROADCAST_LINES:
        wide = F.broadcast(wide)
    # sample -1 has each line once: what was observed
    draws = both.sparkSession.range(-n_lines, samples * n_lines).select(F.floor(F.col("id") / n_lines).alias("sample"), F.pmod("id", F.lit(n_lines)).alias("draw"))
    draws = draws.select("sample", F.when(F.col("sample") < 0, F.col("draw")).otherwise(X.seeded_index(n_lines, seed, "sample", "draw")).alias(line))
    summed = draws.join(wide, line).groupBy("sample").agg(*(F.sum(name(x)).alias(name(x)) for x in cells))
    rows = F.explode(F.array(*(F.struct(F.lit(side).alias("side"), F.lit(order).alias("order"), *(F.col(name((side, order, c))).alias(c) for c in counts)) for side in sides for order in orders)))
    scores = chrf_score(summed.select("sample", rows.alias("x")).select("sample", "x.*"), ["sample", "side"]).groupBy("sample").pivot("side", list(sides)).agg(F.first("chrf"))
    diffs = scores.select("sample", (F.col("right") - F.col("left")).alias("diff"))
    n = float(samples)
    drawn = F.when(F.col("sample") >= 0, F.col("diff"))
    ordered = F.array_sort(F.collect_list(drawn))  # one value a sample: bounded by the parameter
    return diffs.agg(
        F.max(F.when(F.col("sample") < 0, F.col("diff"))).alias("difference"),
        F.get(ordered, F.lit(int(0.025 * (samples - 1)))).alias("low"),
        F.get(ordered, F.lit(int(0.975 * (samples - 1)))).alias("high"),
        F.least(F.lit(1.0), 2 * F.least((F.count_if(drawn <= 0) + 1) / (n + 1), (F.count_if(drawn >= 0) + 1) / (n + 1))).alias("p_value"),
    ).withColumn("significant", F.col("p_value") < 0.05)


def _bigrams(c: Column) -> Column:
    """Neighbouring characters of ^text, as structs prev, next."""
    chars = F.split(F.concat(F.lit("^"), c), "")
    n = F.length(c)
    return F.arrays_zip(F.slice(chars, F.lit(1), n).alias("prev"), F.slice(chars, F.lit(2), n).alias("next"))


def bigram_model(texts: DataFrame, text: str, k: float = 1.0) -> DataFrame:
    """A character-bigram model with add-k smoothing: prev, next, nll (nats)."""
    pairs = texts.filter(F.length(text) > 0).select(F.explode(_bigrams(F.col(text))).alias("b"))
    counts = pairs.groupBy("b.prev", "b.next").agg(F.count("*").alias("n"))
    size = counts.select("next").distinct().agg(F.count("*").alias("v"))
    total = F.sum("n").over(Window.partitionBy("prev"))
    return counts.withColumn("t", total).crossJoin(F.broadcast(size)).select("prev", "next", (-F.ln((F.col("n") + k) / (F.col("t") + k * F.col("v")))).alias("nll"))


def token_losses(texts: DataFrame, keys: list[str], text: str, model: DataFrame, unseen: float = 20.0) -> DataFrame:
    """Summed losses of each text: nll and scored characters. Bigram counts travel, not characters."""
    pairs = texts.filter(F.length(text) > 0).select(*keys, F.explode(_bigrams(F.col(text))).alias("b"))
    counts = pairs.groupBy(*keys, "b.prev", "b.next").agg(F.count("*").alias("n"))
    return counts.join(model, ["prev", "next"], "left").groupBy(*keys).agg(F.sum(F.col("n") * F.coalesce("nll", F.lit(unseen))).alias("nll"), F.sum("n").alias("scored"))


def perplexity(losses: DataFrame, group: list[str], chars: str, size: str) -> DataFrame:
    """Token-weighted loss, perplexity, bits per character and per byte."""
    summed = losses.groupBy(*group).agg(F.sum("nll").alias("nll"), F.sum("scored").alias("scored"), F.sum(chars).alias("chars"), F.sum(size).alias("bytes"))
    return scores_of(summed).select(*group, "scored", "loss", "perplexity", "bits_per_char", "bits_per_byte")


def scores_of(summed: DataFrame) -> DataFrame:
    """Adds loss, perplexity, bits_per_char and bits_per_byte to rows with nll, scored, chars and bytes."""
    bits = F.col("nll") / F.ln(F.lit(2.0))
    loss = F.col("nll") / F.col("scored")
    return summed.select("*", loss.alias("loss"), F.exp(loss).alias("perplexity"), (bits / F.col("chars")).alias("bits_per_char"), (bits / F.col("bytes")).alias("bits_per_byte"))


def place_losses(texts: DataFrame, keys: list[str], text: str, model: DataFrame, unseen: float = 20.0) -> DataFrame:
    """The loss of every character: keys, place (from 0), nll."""
    placed = texts.filter(F.length(text) > 0).select(*keys, F.posexplode(_bigrams(F.col(text))).alias("place", "b"))
    return placed.select(*keys, "place", "b.prev", "b.next").join(model, ["prev", "next"], "left").select(*keys, "place", F.coalesce("nll", F.lit(unseen)).alias("nll"))


def windowed_losses(losses: DataFrame, keys: list[str], stride: int, length: int) -> DataFrame:
    """Summed losses of evaluation windows: keys, window, scored, nll.

    The windows are those of sequences.sliding_windows: a token is scored in the first window that holds it,
    except the first token of an item, which has no context. A window's number follows from the place, so no
    range join is needed.
    """
    window = F.when(F.col("place") < length, 0).otherwise(F.floor((F.col("place") - length) / stride) + 1)
    return losses.filter("place > 0").groupBy(*keys, window.cast("long").alias("window")).agg(F.count("*").alias("scored"), F.sum("nll").alias("nll"))


#: What a candidate can be compared by; less is better.
SCORE_FIELDS = ("total_nll", "loss", "bits_per_char", "bits_per_byte")


def candidate_scores(candidates: DataFrame, keys: list[str], text: str, model: DataFrame) -> DataFrame:
    """keys and the score fields of each candidate text; a candidate without characters has none."""
    sized = candidates.groupBy(*keys).agg(F.sum(F.length(text)).alias("chars"), F.sum(F.octet_length(text)).alias("bytes"))
    found = scores_of(token_losses(candidates, keys, text, model).join(sized, keys))
    return found.select(*keys, F.col("nll").alias("total_nll"), *SCORE_FIELDS[1:])


def skip_reason(reference, prompt_size, full_size, max_length: int) -> Column:
    """Why a pair is not scored, or null."""
    return (
        F.when(F.trim(X.col(reference)) == "", "blank_reference")
        .when(X.col(prompt_size) >= X.col(full_size), "prompt_fills_all")
        .when(X.col(full_size) > max_length, "too_long")
    )


def preferences(scores: DataFrame, correct: str, incorrect: str) -> DataFrame:
    """Adds margin (incorrect - correct), tie and preferred (strictly lower and no tie)."""
    tie = X.is_close(correct, incorrect)
    return scores.withColumn("margin", F.col(incorrect) - F.col(correct)).withColumn("tie", tie).withColumn("preferred", (F.col(correct) < F.col(incorrect)) & ~tie)


def preference_summary(preferred: DataFrame, group: str) -> DataFrame:
    """By group and overall: n, correct, incorrect (ties among them), ties, accuracy, interval, p value, margin."""
    counted = preferred.rollup(group).agg(F.count("*").alias("n"), F.count_if("preferred").alias("correct"), F.count_if("tie").alias("ties"), F.avg("margin").alias("mean_margin"))
    return counted.select(
        F.coalesce(F.col(group).cast("string"), F.lit("overall")).alias(group), "n", "correct", (F.col("n") - F.col("correct")).alias("incorrect"), "ties",
        (F.col("correct") / F.col("n")).alias("accuracy"), X.wilson("correct", "n", False).alias("low"), X.wilson("correct", "n", True).alias("high"),
        X.binomial_p("correct", "n").alias("p_value"), "mean_margin",
    )


def split_delta(rows: DataFrame, group: str, full: Column, right: str) -> DataFrame:
    """By group: accuracy of the full rows, of the simple ones, and full minus simple."""
    value = F.col(right).cast("double")
    found = rows.groupBy(group).agg(F.avg(F.when(full, value)).alias("full"), F.avg(F.when(~full, value)).alias("simple"))
    return found.withColumn("delta", F.col("full") - F.col("simple"))


def suffix_losses(pairs: DataFrame, keys: list[str], prefix: str, suffix: str, model: DataFrame) -> DataFrame:
    """keys, scored and nll of the suffix behind its prefix; no character of the prefix is scored."""
    whole = pairs.select(*keys, F.length(prefix).alias("_from"), F.concat(prefix, suffix).alias("_text"))
    losses = place_losses(whole, [*keys, "_from"], "_text", model)
    return losses.filter("place >= _from").groupBy(*keys).agg(F.count("*").alias("scored"), F.sum("nll").alias("nll"))


def running_accuracy(rows: DataFrame, group: str, order: str, right: str, every: int) -> DataFrame:
    """Accuracy so far within a group, at every ``every``-th row."""
    counted = sampling.running(rows, group, [order], {"seen": F.lit(1), "_right": F.col(right).cast("double")})
    return counted.filter(F.col("seen") % every == 0).select(group, F.col("seen").cast("int").alias("seen"), (F.col("_right") / F.col("seen")).alias("accuracy"))
