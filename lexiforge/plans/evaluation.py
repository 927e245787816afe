"""Queries of evaluation: overlap scores, bootstrap, perplexity, preferences."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import evaluation as E
from ..operators import sampling
from . import mixing
from .tables import sql_index, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
SEED = 42


def query(name: str, oracle: str | None = None):
    def register(f):
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return register


_PAIR_SQL = mixing._PAIR_SQL
_NGRAMS = " UNION ALL ".join(
    [
        f"SELECT conv_id, turn, 'c{n}' AS o, unnest(list_transform(range(1, greatest(length({{s}}) - {n - 2}, 1)), lambda i: substr({{s}}, i, {n}))) AS g FROM p"
        for n in range(1, 7)
    ]
    + [
        f"SELECT conv_id, turn, 'w{n}' AS o, unnest(list_transform(range(1, greatest(len({{w}}) - {n - 2}, 1)), lambda i: array_to_string({{w}}[i:i+{n - 1}], chr(1)))) AS g FROM p"
        for n in (1, 2)
    ]
)


def _stats_sql(hyp: str, ref: str) -> str:
    def side(c):
        return _NGRAMS.format(s=f"regexp_replace({c}, '[\\s\\p{{Z}}]+', '', 'g')", w=f"list_filter(regexp_split_to_array({c}, '[\\s\\p{{Z}}]+'), lambda w: w <> '')")

    return f"""(WITH p AS (SELECT conv_id, turn, prompt AS a, output AS b, reverse(prompt) AS c FROM ({_PAIR_SQL})),
      h AS (SELECT conv_id, turn, o, g, count(*) AS n FROM ({side(hyp)}) GROUP BY ALL), r AS (SELECT conv_id, turn, o, g, count(*) AS n FROM ({side(ref)}) GROUP BY ALL),
      j AS (SELECT conv_id, turn, o, coalesce(h.n, 0) AS h, coalesce(r.n, 0) AS r FROM h FULL JOIN r USING (conv_id, turn, o, g))
      SELECT conv_id, turn, o AS "order", sum(h)::BIGINT AS hyp, sum(r)::BIGINT AS ref, sum(least(h, r))::BIGINT AS "match" FROM j GROUP BY ALL)"""


def _score_sql(stats: str, keys: str) -> str:
    comma = f"{keys}," if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    return f"""(SELECT {comma} CASE WHEN p + r > 0 THEN 100 * 5 * p * r / (4 * p + r) ELSE 0 END AS chrf FROM (SELECT {comma} avg(m / h) AS p, avg(m / f) AS r FROM (
      SELECT {comma} "order", sum(hyp)::DOUBLE AS h, sum(ref)::DOUBLE AS f, sum("match")::DOUBLE AS m FROM {stats} GROUP BY {comma} "order") WHERE h > 0 AND f > 0 {group}))"""


def _texts(spark, d):
    pairs = mixing._replies(spark, d)
    return pairs.select("conv_id", "turn", F.col("instruction").alias("a"), F.col("output").alias("b"), F.reverse("instruction").alias("c"))


@query("chrf_stats", _stats_sql("b", "a")[1:-1])
def chrf_stats(spark, d):
    return E.chrf_stats(_texts(spark, d), ["conv_id", "turn"], "b", "a")


@query("chrf_corpus", f"SELECT round(chrf, 6) AS chrf FROM {_score_sql(_stats_sql('b', 'a'), '')}")
def chrf_corpus(spark, d):
    return E.chrf_score(E.chrf_stats(_texts(spark, d), ["conv_id", "turn"], "b", "a"), []).select(F.round("chrf", 6).alias("chrf"))


@query("chrf_sentence", f"SELECT conv_id, turn, round(chrf, 6) AS chrf FROM {_score_sql(_stats_sql('b', 'a'), 'conv_id, turn')}")
def chrf_sentence(spark, d):
    return E.chrf_score(E.chrf_stats(_texts(spark, d), ["conv_id", "turn"], "b", "a"), ["conv_id", "turn"]).withColumn("chrf", F.round("chrf", 6))


#: Samples of the bootstrap, as many as the default asks for.
_SAMPLES = 1000


@query(
    "bootstrap_chrf",
    f"""WITH l AS (SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) - 1 AS line FROM ({_PAIR_SQL})), c AS (SELECT count(*) AS n FROM l),
    s AS MATERIALIZED (SELECT 'left' AS side, line, "order", hyp, ref, "match" FROM {_stats_sql('c', 'a')} JOIN l USING (conv_id, turn) UNION ALL SELECT 'right', line, "order", hyp, ref, "match" FROM {_stats_sql('b', 'a')} JOIN l USING (conv_id, turn)),
    w AS MATERIALIZED (SELECT sample, {sql_index('n', SEED, 'sample', 'draw')} AS line, count(*) AS w FROM c, range({_SAMPLES}) a(sample), (SELECT unnest(range(n)) AS draw FROM c) b GROUP BY 1, 2),
    x AS (SELECT sample, side, "order", sum(hyp * w) AS hyp, sum(ref * w) AS ref, sum("match" * w) AS "match" FROM s JOIN w USING (line) GROUP BY ALL),
    f AS (SELECT sample, max(chrf) FILTER (side = 'right') - max(chrf) FILTER (side = 'left') AS diff FROM {_score_sql('x', 'sample, side')} GROUP BY sample),
    o AS (SELECT max(chrf) FILTER (side = 'right') - max(chrf) FILTER (side = 'left') AS difference FROM {_score_sql('s', 'side')}),
    z AS (SELECT list_sort(list(diff)) AS v, count(*) FILTER (diff <= 0) AS le, count(*) FILTER (diff >= 0) AS ge FROM f)
    SELECT round(difference, 6) AS difference, round(v[{int(0.025 * (_SAMPLES - 1)) + 1}], 6) AS low, round(v[{int(0.975 * (_SAMPLES - 1)) + 1}], 6) AS high,
      round(least(1.0, 2 * least((le + 1) / {_SAMPLES + 1}.0, (ge + 1) / {_SAMPLES + 1}.0)), 6) AS p_value, least(1.0, 2 * least((le + 1) / {_SAMPLES + 1}.0, (ge + 1) / {_SAMPLES + 1}.0)) < 0.05 AS significant FROM o, z""",
)
def bootstrap_chrf(spark, d):
    texts = _texts(spark, d)
    keys, n = sampling.numbered(texts.select("conv_id", "turn"), "line", "conv_id", "turn")
    lines = texts.join(keys, ["conv_id", "turn"])
    sides = F.explode(F.array(F.struct(F.lit("left").alias("side"), F.col("c").alias("h")), F.struct(F.lit("right").alias("side"), F.col("b").alias("h")))).alias("s")
    both = E.chrf_stats(lines.select("line", "a", sides).select("line", "a", "s.*"), ["side", "line"], "h", "a")
    found = E.paired_bootstrap(both, "line", max(n, 1), _SAMPLES, SEED)
    return found.select(*(F.round(c, 6).alias(c) for c in ("difference", "low", "high", "p_value")), "significant")


_BIGRAMS = "unnest(list_transform(range(1, length({t}) + 1), lambda i: substr('^' || {t}, i, 1))) AS prev, unnest(list_transform(range(1, length({t}) + 1), lambda i: substr('^' || {t}, i + 1, 1))) AS next"
_MODEL = f"""m AS (SELECT prev, next, count(*) AS n FROM (SELECT {_BIGRAMS.format(t='text')} FROM benchmark) GROUP BY 1, 2),
  q AS (SELECT prev, next, -ln((n + 1.0) / (sum(n) OVER (PARTITION BY prev) + (SELECT count(DISTINCT next) FROM m))) AS nll FROM m)"""


def _model(spark, d):
    return E.bigram_model(table(spark, d, "benchmark"), "text")


@query(
    "ppl_bpc",
    f"""WITH {_MODEL}, c AS (SELECT doc_id, prev, next, count(*) AS n FROM (SELECT doc_id, {_BIGRAMS.format(t='text')} FROM documents) GROUP BY ALL),
    l AS (SELECT doc_id, sum(n * coalesce(nll, 20.0)) AS nll, sum(n) AS scored FROM c LEFT JOIN q USING (prev, next) GROUP BY doc_id),
    s AS (SELECT lang, sum(nll) AS nll, sum(scored)::BIGINT AS scored, sum(length(text)) AS chars, sum(strlen(text)) AS bytes FROM l JOIN documents USING (doc_id) GROUP BY lang)
    SELECT lang, scored, round(nll / scored, 6) AS loss, round(exp(nll / scored), 4) AS perplexity, round(nll / ln(2) / chars, 6) AS bits_per_char, round(nll / ln(2) / bytes, 6) AS bits_per_byte FROM s""",
)
def ppl_bpc(spark, d):
    docs = table(spark, d, "documents")
    losses = E.token_losses(docs.select("lang", "text"), ["lang"], "text", _model(spark, d))
    sized = docs.filter(F.length("text") > 0).groupBy("lang").agg(F.sum(F.length("text")).alias("chars"), F.sum(F.octet_length("text")).alias("bytes"))
    found = E.scores_of(losses.join(sized, "lang"))
    return found.select("lang", "scored", F.round("loss", 6).alias("loss"), F.round("perplexity", 4).alias("perplexity"), *(F.round(c, 6).alias(c) for c in ("bits_per_char", "bits_per_byte")))


_STRIDE, _LENGTH = 256, 1024


@query(
    "ppl_windows",
    f"""WITH {_MODEL}, c AS (SELECT conv_id, turn, length(text) AS total, unnest(range(length(text))) AS place, {_BIGRAMS.format(t='text')} FROM conversations WHERE length(text) > 0),
    l AS (SELECT conv_id, turn, total, place, coalesce(nll, 20.0) AS nll FROM c LEFT JOIN q USING (prev, next)),
    w AS (SELECT conv_id, turn, b, least(b + {_LENGTH}, length(text)) AS e, CASE WHEN b = 0 THEN 1 ELSE least(b - {_STRIDE} + {_LENGTH}, length(text)) END AS first FROM (SELECT *, unnest(range(0, length(text), {_STRIDE})) AS b FROM conversations) WHERE b = 0 OR b - {_STRIDE} + {_LENGTH} < length(text))
    SELECT w.conv_id, w.turn, b // {_STRIDE} AS "window", count(*) AS scored, round(sum(nll) / count(*), 6) AS loss FROM w JOIN l ON l.conv_id = w.conv_id AND l.turn = w.turn AND place >= first AND place < e GROUP BY 1, 2, 3""",
)
def ppl_windows(spark, d):
    """Perplexity by windows with a stride: each token is scored once, in the first window that holds it."""
    losses = E.place_losses(table(spark, d, "conversations"), ["conv_id", "turn"], "text", _model(spark, d))
    return E.windowed_losses(losses, ["conv_id", "turn"], _STRIDE, _LENGTH).select("conv_id", "turn", "window", "scored", F.round(F.col("nll") / F.col("scored"), 6).alias("loss"))


@query(
    "linewise_ppl",
    f"""WITH {_MODEL}, l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line FROM conversations), c AS (SELECT conv_id, turn, prev, next, count(*) AS n FROM (SELECT conv_id, turn, {_BIGRAMS.format(t='line')} FROM l) GROUP BY ALL)
    SELECT conv_id, turn, sum(n)::BIGINT AS scored, round(exp(sum(n * coalesce(nll, 20.0)) / sum(n)), 4) AS perplexity FROM c LEFT JOIN q USING (prev, next) GROUP BY conv_id, turn""",
)
def linewise_ppl(spark, d):
    """Perplexity of lines that each stand behind the same prefix: neither the prefix nor the separator is scored."""
    lines = table(spark, d, "conversations").select("conv_id", "turn", F.explode(F.split("text", "\n")).alias("line"))
    losses = E.token_losses(lines, ["conv_id", "turn"], "line", _model(spark, d))
    return losses.select("conv_id", "turn", "scored", F.round(F.exp(F.col("nll") / F.col("scored")), 4).alias("perplexity"))


@query(
    "cond_ppl",
    f"""WITH {_MODEL}, p AS (SELECT conv_id, turn, output, CASE WHEN trim(output) = '' THEN 'blank_reference' WHEN length(prompt) >= length(prompt) + length(output) THEN 'prompt_fills_all' WHEN length(prompt) + length(output) > 1500 THEN 'too_long' END AS reason FROM ({_PAIR_SQL})),
    c AS (SELECT prev, next, count(*) AS n FROM (SELECT {_BIGRAMS.format(t='output')} FROM p WHERE reason IS NULL) GROUP BY ALL),
    l AS (SELECT sum(n * coalesce(nll, 20.0)) AS nll, sum(n) AS scored FROM c LEFT JOIN q USING (prev, next))
    SELECT count(*) FILTER (reason IS NULL) AS used, count(*) FILTER (reason IS NOT NULL) AS skipped, (SELECT round(exp(nll / scored), 4) FROM l) AS perplexity FROM p""",
)
def cond_ppl(spark, d):
    pairs = mixing._replies(spark, d).withColumn("k", F.concat_ws(":", "conv_id", "turn"))
    full = F.length("instruction") + F.length("output")
    marked = pairs.withColumn("reason", E.skip_reason("output", F.length("instruction"), full, 1500))
    losses = E.token_losses(marked.filter("reason IS NULL").select("k", "output"), ["k"], "output", _model(spark, d))
    total = losses.agg(F.round(F.exp(F.sum("nll") / F.sum("scored")), 4).alias("perplexity"))
    counts = marked.agg(F.count_if(F.col("reason").isNull()).alias("used"), F.count_if(F.col("reason").isNotNull()).alias("skipped"))
    return counts.crossJoin(F.broadcast(total))


#: Correct: what a user wrote; incorrect: the same words with the characters of each turned round.
_TURNED = "array_to_string(list_transform(string_split(prompt, ' '), lambda w: reverse(w)), ' ')"
_PREF = f"""WITH {_MODEL}, p AS (SELECT conv_id, turn, prompt, {_TURNED} AS turned FROM ({_PAIR_SQL}) WHERE length(prompt) > 0),
  t AS (SELECT conv_id, turn, 'a' AS side, prompt AS text FROM p UNION ALL SELECT conv_id, turn, 'b', turned FROM p),
  c AS (SELECT conv_id, turn, side, prev, next, count(*) AS n FROM (SELECT conv_id, turn, side, {_BIGRAMS.format(t='text')} FROM t) GROUP BY ALL),
  l AS (SELECT conv_id, turn, side, sum(n * coalesce(nll, 20.0)) AS nll, sum(n) AS scored FROM c LEFT JOIN q USING (prev, next) GROUP BY ALL),
  f AS (SELECT conv_id, turn, side, unnest(['total_nll', 'loss', 'bits_per_char', 'bits_per_byte']) AS score_field, unnest([nll, nll / scored, nll / ln(2) / length(text), nll / ln(2) / strlen(text)]) AS v FROM l JOIN t USING (conv_id, turn, side)),
  s AS (SELECT conv_id, turn, score_field, max(v) FILTER (side = 'a') AS a, max(v) FILTER (side = 'b') AS b FROM f GROUP BY ALL),
  r AS (SELECT conv_id, turn, score_field, b - a AS margin, abs(a - b) <= greatest(1e-9 * greatest(abs(a), abs(b)), 1e-12) AS tie, a < b AND abs(a - b) > greatest(1e-9 * greatest(abs(a), abs(b)), 1e-12) AS preferred FROM s)"""


def _preferred(spark, d):
    """Both candidates of every pair scored by the model, a row for each score field."""
    pairs = mixing._replies(spark, d).filter(F.length("instruction") > 0)
    turned = F.array_join(F.transform(F.split("instruction", " "), F.reverse), " ")
    sides = F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("instruction").alias("text")), F.struct(F.lit("b").alias("side"), turned.alias("text")))).alias("s")
    candidates = pairs.select("conv_id", "turn", sides).select("conv_id", "turn", "s.*")
    scores = E.candidate_scores(candidates, ["conv_id", "turn", "side"], "text", _model(spark, d))
    fields = F.explode(F.array(*(F.struct(F.lit(f).alias("score_field"), F.col(f).alias("v")) for f in E.SCORE_FIELDS))).alias("f")
    rows = scores.select("conv_id", "turn", "side", fields).select("conv_id", "turn", "side", "f.*")
    wide = rows.groupBy("conv_id", "turn", "score_field").agg(*(F.max(F.when(F.col("side") == s, F.col("v"))).alias(s) for s in ("a", "b")))
    return E.preferences(wide, "a", "b")


@query("minimal_pair", f"{_PREF} SELECT conv_id, turn, score_field, round(margin, 6) + 0.0 AS margin, tie, preferred FROM r")
def minimal_pair(spark, d):
    return _preferred(spark, d).select("conv_id", "turn", "score_field", (F.round("margin", 6) + 0.0).alias("margin"), "tie", "preferred")


@query(
    "pair_summary",
    f"""{_PREF}, s2 AS (SELECT coalesce(score_field, 'overall') AS score_field, count(*) AS n, count(*) FILTER (preferred) AS k, count(*) FILTER (tie) AS ties, avg(margin) AS margin FROM r GROUP BY ROLLUP (score_field)),
    c2 AS (SELECT s2.score_field, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))) AS p FROM s2, (SELECT unnest(range(max(n) + 1)) AS i FROM s2) WHERE i <= n AND exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2)) <= exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) - n * ln(2)) * (1 + 1e-9) GROUP BY 1)
    SELECT s2.score_field, n, k AS correct, n - k AS incorrect, ties, round(k / n, 6) AS accuracy,
      round((k / n + 3.841458820694124 / (2 * n) - 1.959963984540054 * sqrt(k / n * (1 - k / n) / n + 3.841458820694124 / (4.0 * n * n))) / (1 + 3.841458820694124 / n), 6) AS low,
      round((k / n + 3.841458820694124 / (2 * n) + 1.959963984540054 * sqrt(k / n * (1 - k / n) / n + 3.841458820694124 / (4.0 * n * n))) / (1 + 3.841458820694124 / n), 6) AS high,
      round(least(c2.p, 1.0), 4) AS p_value, round(margin, 6) AS mean_margin FROM s2 JOIN c2 USING (score_field)""",
)
def pair_summary(spark, d):
    found = E.preference_summary(_preferred(spark, d), "score_field")
    return found.select("score_field", "n", "correct", "incorrect", "ties", *(F.round(c, 6).alias(c) for c in ("accuracy", "low", "high")), F.round("p_value", 4).alias("p_value"), F.round("mean_margin", 6).alias("mean_margin"))


@query("running_accuracy", "SELECT quality, seen::INT AS seen, round(accuracy, 6) AS accuracy FROM (SELECT quality, row_number() OVER w AS seen, avg(toxic) OVER (PARTITION BY quality ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS accuracy FROM labels WINDOW w AS (PARTITION BY quality ORDER BY doc_id)) WHERE seen % 10 = 0")
def running_accuracy(spark, d):
    return E.running_accuracy(table(spark, d, "labels"), "quality", "doc_id", "toxic", 10).withColumn("accuracy", F.round("accuracy", 6))


_WORDS = "len(list_filter(regexp_split_to_array(text, '[\\s\\p{Z}]+'), lambda w: w <> ''))"


@query("fertility", f"SELECT doc_id, round(t / greatest(1, w), 6) AS fertility, t / greatest(1, w) > 2.0 AS high FROM (SELECT doc_id, len(list_filter(regexp_extract_all(text, '\\p{{L}}{{1,4}}|\\p{{N}}|[^\\p{{L}}\\p{{N}}\\s]'), lambda x: true)) AS t, {_WORDS} AS w FROM documents)")
def fertility(spark, d):
    pieces = F.size(F.regexp_extract_all("text", F.lit(r"\p{L}{1,4}|\p{N}|[^\p{L}\p{N}\s]"), F.lit(0)))
    value = pieces / F.greatest(F.lit(1), X.word_count("text"))
    return table(spark, d, "documents").select("doc_id", F.round(value, 6).alias("fertility"), (value > 2.0).alias("high"))


@query("accuracy_delta", "SELECT lang, round(avg(quality) FILTER (n_chars >= 1000), 6) AS \"full\", round(avg(quality) FILTER (n_chars < 1000), 6) AS simple, round(avg(quality) FILTER (n_chars >= 1000) - avg(quality) FILTER (n_chars < 1000), 6) AS delta FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def accuracy_delta(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang", "n_chars").join(table(spark, d, "labels"), "doc_id")
    return E.split_delta(rows, "lang", F.col("n_chars") >= 1000, "quality").select("lang", *(F.round(c, 6).alias(c) for c in ("full", "simple", "delta")))


@query(
    "suffix_losses",
    f"""WITH {_MODEL}, p AS (SELECT conv_id, turn, length(prompt) AS f, prompt || output AS t FROM ({_PAIR_SQL})),
    c AS (SELECT conv_id, turn, f, unnest(range(length(t))) AS place, {_BIGRAMS.format(t='t')} FROM p)
    SELECT conv_id, turn, count(*) AS scored, round(sum(coalesce(nll, 20.0)) / count(*), 6) AS loss FROM c LEFT JOIN q USING (prev, next) WHERE place >= f GROUP BY 1, 2""",
)
def suffix_losses(spark, d):
    found = E.suffix_losses(mixing._replies(spark, d), ["conv_id", "turn"], "instruction", "output", _model(spark, d))
    return found.select("conv_id", "turn", "scored", F.round(F.col("nll") / F.col("scored"), 6).alias("loss"))
