"""Queries of vectors, weights and routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions.storage import stored
from ..operators import evaluation, merging, routing, vectors
from .tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(f):
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return register


_LONG = "(SELECT vec_id, label, unnest(range(len(embedding))) AS idx, unnest(embedding)::DOUBLE AS value FROM embeddings)"


@query("mean_vector", f"SELECT label, idx::INT AS idx, round(avg(value), 6) AS value FROM {_LONG} GROUP BY label, idx")
def mean_vector(spark, d):
    return vectors.mean_vectors(table(spark, d, "embeddings"), "label", "embedding").withColumn("value", F.round("value", 6))


@query("weighted_init", f"SELECT (vec_id % 20)::BIGINT AS token, idx::INT AS idx, round(sum(value * (1 + vec_id % 3)) / sum(1 + vec_id % 3), 6) AS value FROM {_LONG} WHERE label <> 0 GROUP BY 1, 2")
def weighted_init(spark, d):
    rows = table(spark, d, "embeddings")
    links = rows.select((F.col("vec_id") % 20).alias("token"), F.col("vec_id").alias("other"), (1.0 + F.col("vec_id") % 3).alias("weight"))
    known = rows.filter("label <> 0")  # so some links lead to nothing
    return vectors.weighted_vectors(links, "token", "other", "weight", known, "vec_id", "embedding").withColumn("value", F.round("value", 6))


@query("vector_stats", f"WITH v AS (SELECT vec_id, label, sum(abs(value)) AS s, max(abs(value)) AS m, count(*) AS n, count(*) FILTER (abs(value) > 0) AS z FROM {_LONG} GROUP BY 1, 2) SELECT label, round(sum(s) / sum(n), 6) AS mean_abs, round(max(m), 6) AS max_abs, round(100.0 * sum(z) / sum(n), 6) AS nonzero_percent, count(*) FILTER (m < 1e-8) AS dead FROM v GROUP BY label")
def vector_stats(spark, d):
    found = vectors.vector_stats(table(spark, d, "embeddings"), "label", "embedding")
    return found.select("label", *(F.round(c, 6).alias(c) for c in ("mean_abs", "max_abs", "nonzero_percent")), "dead")


@query(
    "ties_merge",
    f"""WITH m AS (SELECT (vec_id % 2)::VARCHAR AS key, label::VARCHAR AS model, idx, avg(value) AS value FROM {_LONG} GROUP BY vec_id % 2, label, idx),
    k AS (SELECT *, count(*) OVER (PARTITION BY key, model) AS n, row_number() OVER (PARTITION BY key, model ORDER BY abs(value) DESC, idx) AS r FROM m),
    t AS (SELECT key, idx, CASE WHEN r <= greatest(floor(n * 0.2), 1) THEN value ELSE 0 END AS value, (model::INT + 1) / 10.0 AS w FROM k),
    s AS (SELECT *, sign(sum(value * w) OVER (PARTITION BY key, idx)) AS sg FROM t)
    SELECT key, idx::INT AS idx, round(coalesce(sum(value * w) FILTER (sign(value) = sg AND value <> 0), 0) / (CASE WHEN coalesce(sum(w) FILTER (sign(value) = sg AND value <> 0), 0) = 0 THEN 1 ELSE sum(w) FILTER (sign(value) = sg AND value <> 0) END), 6) + 0.0 AS value FROM s GROUP BY key, idx""",
)
def ties_merge(spark, d):
    """Every label is a model and weighs by its number; even and odd vectors are two keys."""
    rows = table(spark, d, "embeddings").withColumn("part", F.concat_ws(":", F.col("vec_id") % 2, "label"))
    part = F.split("part", ":")
    parts = vectors.mean_vectors(rows, "part", "embedding").select(part[0].alias("key"), part[1].alias("model"), "idx", "value")
    parts = stored(parts)  # read once for each pass of the selection
    merged = merging.ties_merge(parts, "key", "model", (F.col("model").cast("int") + 1) / 10, F.lit(0.2))
    return merged.select("key", "idx", (F.round("value", 6) + 0.0).alias("value"))


#: Tensors' names as checkpoints have them: saved and original modules, factors of low rank, a whole output tensor.
_TENSORS = ["model.embed_tokens.modules_to_save.weight", "model.embed_tokens.original_module.weight", "layers.0.lora_A.weight", "lm_head.lora_B.weight", "lm_head.weight"]


@query(
    "merge_weights",
    f"""WITH m AS (SELECT {_TENSORS}[(vec_id % 5)::INT + 1] AS raw, (label % 2)::VARCHAR AS model, (label // 2 * 64 + idx)::BIGINT AS idx, avg(value) AS value FROM {_LONG} GROUP BY 1, 2, 3),
    c AS (SELECT replace(replace(raw, '.modules_to_save', ''), '.original_module', '') AS key, raw, CASE WHEN contains(raw, '.modules_to_save') THEN 3 WHEN contains(raw, '.original_module') THEN 1 ELSE 2 END AS p, model, idx, value FROM m),
    b AS (SELECT * FROM c QUALIFY p = max(p) OVER (PARTITION BY key)),
    k AS (SELECT *, count(*) OVER (PARTITION BY key, model) AS n, row_number() OVER (PARTITION BY key, model ORDER BY abs(value) DESC, idx) AS r,
      CASE WHEN regexp_matches(key, 'embed_tokens|lm_head') AND NOT regexp_matches(key, 'lora_[AB]') THEN 1.0 ELSE 0.2 END AS density FROM b),
    t AS (SELECT key, idx, CASE WHEN r <= greatest(floor(n * density), 1) THEN value ELSE 0 END AS value, CASE WHEN model = '0' THEN 0.7 ELSE 0.3 END AS w FROM k),
    s AS (SELECT *, sign(sum(value * w) OVER (PARTITION BY key, idx)) AS sg FROM t)
    SELECT key, idx, round(coalesce(sum(value * w) FILTER (sign(value) = sg AND value <> 0), 0) / (CASE WHEN coalesce(sum(w) FILTER (sign(value) = sg AND value <> 0), 0) = 0 THEN 1 ELSE sum(w) FILTER (sign(value) = sg AND value <> 0) END) * 0.5, 6) + 0.0 AS value FROM s GROUP BY key, idx""",
)
def merge_weights(spark, d):
    """Two models with five tensors each, whose values are means of vectors: names cleaned, then merged."""
    rows = vectors.long_form(table(spark, d, "embeddings"), ["vec_id", "label"], "embedding")
    key = F.element_at(F.array(*map(F.lit, _TENSORS)), (F.col("vec_id") % 5 + 1).cast("int"))
    place = (F.floor(F.col("label") / 2) * 64 + F.col("idx")).cast("long")
    parts = rows.groupBy(key.alias("key"), (F.col("label") % 2).cast("string").alias("model"), place.alias("idx")).agg(F.avg("value").alias("value"))
    parts = stored(parts)
    models = {name: parts.filter(F.col("model") == name).drop("model") for name in ("0", "1")}
    merged = merging.merge_files(models, {"0": 0.7, "1": 0.3}, 0.2, scale=0.5)
    return merged.select("key", "idx", (F.round("value", 6) + 0.0).alias("value"))


_COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


def _neighbours(spark, d):
    rows = table(spark, d, "embeddings")
    return rows.select("vec_id", F.col("embedding").alias("a")).join(rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")


@query("cosine_pairs", f"SELECT a.vec_id, round({_COS}, 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_pairs(spark, d):
    return _neighbours(spark, d).select("vec_id", F.round(X.cosine("a", "b"), 6).alias("cosine"))


@query("drift_tie", f"SELECT a.vec_id, round(1 - {_COS}, 6) AS drift, 1 - {_COS} > 1.0 AS averaged, round(CASE WHEN 1 - {_COS} > 1.0 THEN (a.embedding[1]::DOUBLE + b.embedding[1]::DOUBLE) / 2 ELSE a.embedding[1]::DOUBLE END, 6) AS first FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def drift_tie(spark, d):
    tied = vectors.drift_tied(_neighbours(spark, d), "a", "b", 1.0)
    return tied.select("vec_id", F.round("drift", 6).alias("drift"), "averaged", F.round(F.element_at("tied", 1), 6).alias("first"))


@query(
    "router_softmax",
    """WITH l AS (SELECT vec_id, [embedding[1]::DOUBLE, embedding[2]::DOUBLE, embedding[3]::DOUBLE + 1.0] AS x FROM embeddings), e AS (SELECT vec_id, x, list_transform(x, lambda v: exp((v - list_max(x)) / 0.5)) AS g FROM l)
    SELECT vec_id, round(g[1] / list_sum(g), 6) AS a, round(g[2] / list_sum(g), 6) AS b, round(g[3] / list_sum(g), 6) AS c, list_position(x, list_max(x))::INT AS hard FROM e""",
)
def router_softmax(spark, d):
    logits = X.route_logits(F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double")), bias={2: 1.0})
    rows = table(spark, d, "embeddings").withColumn("x", logits).withColumn("g", X.softmax("x", 0.5)).withColumn("h", X.one_hot_max("x"))
    return rows.select("vec_id", *(F.round(F.element_at("g", k + 1), 6).alias(n) for k, n in enumerate("abc")), F.array_position("h", F.lit(1.0)).cast("int").alias("hard"))


_COUNTS = "(SELECT {k} AS k, b, count(*)::DOUBLE AS n FROM (SELECT {k}, unnest(list_transform(range(1, length({w}) + 2), lambda i: substr('^' || lower({w}) || '$', i, 2))) AS b FROM {t}) GROUP BY 1, 2)"


@query(
    "ngram_cosine",
    f"""WITH a AS {_COUNTS.format(k='p_partkey', w='p_name', t='part')}, b AS {_COUNTS.format(k='p_partkey', w='p_type', t='part')},
    na AS (SELECT k, sqrt(sum(n * n)) AS s FROM a GROUP BY k), nb AS (SELECT k, sqrt(sum(n * n)) AS s FROM b GROUP BY k),
    d AS (SELECT a.k, sum(a.n * b.n) AS s FROM a JOIN b ON a.k = b.k AND a.b = b.b GROUP BY a.k)
    SELECT na.k AS p_partkey, round(coalesce(d.s, 0) / (na.s * nb.s), 6) AS similarity FROM na JOIN nb ON na.k = nb.k LEFT JOIN d ON d.k = na.k""",
)
def ngram_cosine(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(evaluation.bigram_cosine("p_name", "p_type"), 6).alias("similarity"))


@query("align_weights", "SELECT l_orderkey, l_linenumber, round(CASE WHEN l_linenumber % 2 = 0 THEN (l_discount + 0.01) / (l_discount + l_tax + 0.02) ELSE l_discount END, 2) AS first FROM lineitem")
def align_weights(spark, d):
    items = table(spark, d, "lineitem")
    scores = F.when(F.col("l_linenumber") % 2 == 0, F.array("l_discount", "l_tax")).otherwise(F.array("l_discount"))
    weighted = vectors.aligned_weights(items.withColumn("scores", scores), "scores")
    exact = F.when(F.size("scores") == 2, (F.col("scores")[0] + 0.01) / (F.col("scores")[0] + F.col("scores")[1] + 0.02)).otherwise(F.col("scores")[0])
    close = F.abs(F.col("weights")[0] - exact) <= 0.0005000001
    return weighted.select("l_orderkey", "l_linenumber", F.when(close, F.round(exact, 2)).otherwise(-1.0).alias("first"))


_GATES = "(SELECT (user_id % 7)::INT AS layer, CASE WHEN event_id % 2 = 0 THEN 'token' ELSE 'sequence' END AS mode, event_type AS expert, value AS gate FROM events)"


def _gates(spark, d):
    mode = F.when(F.col("event_id") % 2 == 0, "token").otherwise("sequence")
    return table(spark, d, "events").select((F.col("user_id") % 7).cast("int").alias("layer"), mode.alias("mode"), F.col("event_type").alias("expert"), F.col("value").alias("gate"))


@query("gate_grouping_sets", f"SELECT coalesce(layer::VARCHAR, 'all') AS layer, coalesce(mode, 'all') AS mode, expert, round(avg(gate), 6) AS mean, count(*) AS n FROM {_GATES} GROUP BY GROUPING SETS ((expert), (layer, expert), (mode, expert))")
def gate_grouping_sets(spark, d):
    means = routing.gate_means(_gates(spark, d), "expert", "layer", "mode", "gate")
    return means.select(*(F.coalesce(F.col(c).cast("string"), F.lit("all")).alias(c) for c in ("layer", "mode")), "expert", F.round("mean", 6).alias("mean"), "n")


@query("dominant_expert", f"SELECT layer, expert, round(mean, 6) AS mean, mean >= 40 AS collapsed FROM (SELECT layer, expert, avg(gate) AS mean, row_number() OVER (PARTITION BY layer ORDER BY avg(gate) DESC, expert) AS r FROM {_GATES} GROUP BY layer, expert) WHERE r = 1")
def dominant_expert(spark, d):
    means = _gates(spark, d).groupBy("layer", "expert").agg(F.avg("gate").alias("mean"))
    return routing.dominant(means, ["layer"], "expert", "mean", 40.0).withColumn("mean", F.round("mean", 6))


@query("expert_ranking", f"SELECT expert, round(avg(gate), 6) AS mean, row_number() OVER (ORDER BY avg(gate) DESC, expert)::INT AS rank FROM {_GATES} GROUP BY expert")
def expert_ranking(spark, d):
    return routing.ranking(_gates(spark, d), "expert", "gate").withColumn("mean", F.round("mean", 6))


_SCOPED = "(SELECT event_type, event_id % 3 = 0 AS r, value AS fr, value * (event_id % 5) / 2 AS ca, value * (event_id % 7) / 3 AS oc FROM events)"


@query(
    "routing_summary",
    f"""WITH s AS (SELECT event_type, 'full' AS scope, fr, ca, oc FROM {_SCOPED} UNION ALL SELECT event_type, 'response', fr, ca, oc FROM {_SCOPED} WHERE r),
    m AS (SELECT event_type, scope, count(*) AS num_tokens, avg(fr) AS f, avg(ca) AS c, avg(oc) AS o FROM s GROUP BY 1, 2)
    SELECT event_type, scope, num_tokens, round(f, 6) AS fr_mean, round(c, 6) AS ca_mean, round(o, 6) AS oc_mean, CASE greatest(f, c, o) WHEN f THEN 'fr' WHEN c THEN 'ca' ELSE 'oc' END AS top_expert, round(greatest(f, c, o), 6) AS top_mean FROM m""",
)
def routing_summary(spark, d):
    e = table(spark, d, "events")
    rows = e.select("event_type", (F.col("event_id") % 3 == 0).alias("r"), F.col("value").alias("fr"), (F.col("value") * (F.col("event_id") % 5) / 2).alias("ca"), (F.col("value") * (F.col("event_id") % 7) / 3).alias("oc"))
    found = routing.scoped_summary(rows, ["event_type"], "r", ["fr", "ca", "oc"])
    return found.select("event_type", "scope", "num_tokens", *(F.round(f"{x}_mean", 6).alias(f"{x}_mean") for x in ("fr", "ca", "oc")), "top_expert", F.round("top_mean", 6).alias("top_mean"))


@query("routing_pivot", f"SELECT expert, round(coalesce(100 * avg(gate) FILTER (mode = 'token'), 0), 6) AS token, round(coalesce(100 * avg(gate) FILTER (mode = 'sequence'), 0), 6) AS sequence FROM {_GATES} GROUP BY expert")
def routing_pivot(spark, d):
    return routing.pivoted(_gates(spark, d), "expert", "mode", ["token", "sequence"], F.round(100 * F.avg("gate"), 6))


@query("locf_gap", """SELECT event_id, round(b - a, 6) AS gap FROM (SELECT event_id, last_value(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS) OVER w AS a, last_value(CASE WHEN event_type = 'click' THEN value END IGNORE NULLS) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) WHERE a IS NOT NULL AND b IS NOT NULL""")
def locf_gap(spark, d):
    return routing.carried_gap(table(spark, d, "events"), "user_id", "event_id", "event_type", "view", "click", "value").select("event_id", F.round("gap", 6).alias("gap"))


@query("span_flag", """WITH a AS (SELECT *, min(event_id) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id) AS s FROM events), b AS (SELECT *, min(event_id) FILTER (event_type = 'error' AND event_id > s) OVER (PARTITION BY user_id) AS t FROM a) SELECT event_id, coalesce(event_id > s AND (t IS NULL OR event_id < t), false) AS in_span FROM b""")
def span_flag(spark, d):
    rows = routing.span_flags(table(spark, d, "events"), "user_id", "event_id", F.col("event_type") == "purchase", F.col("event_type") == "error")
    return rows.select("event_id", "in_span")


@query(
    "early_stop",
    """WITH a AS (SELECT *, min(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM events), b AS (SELECT *, (best IS NULL OR value < best) AS improved, sum((best IS NULL OR value < best)::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM a),
    c AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY event_id) - 1 AS stale FROM b), e AS (SELECT *, min(event_id) FILTER (stale >= 3) OVER (PARTITION BY user_id) AS stop FROM c)
    SELECT event_id, improved, stale::INT AS stale FROM e WHERE stop IS NULL OR event_id <= stop""",
)
def early_stop(spark, d):
    return routing.early_stop(table(spark, d, "events"), "user_id", "event_id", "value", 3).select("event_id", "improved", "stale")


@query("layer_pick", "SELECT event_type, max(CASE WHEN user_id % 5 = 0 THEN -1 ELSE user_id END)::INT AS deepest, min(CASE WHEN user_id % 5 = 0 THEN -1 ELSE user_id END)::INT AS shallowest FROM events GROUP BY event_type")
def layer_pick(spark, d):
    name = F.when(F.col("user_id") % 5 == 0, "router").otherwise(F.concat(F.lit("layers."), F.col("user_id").cast("string"), F.lit(".router")))
    return routing.layer_picks(table(spark, d, "events").withColumn("name", name), "name", "event_type")


_LINKS = "(SELECT vec_id % 211 AS token, vec_id AS other FROM embeddings)"


def _cognates(spark, d):
    rows = table(spark, d, "embeddings")
    return rows.select((F.col("vec_id") % 211).alias("token"), F.col("vec_id").alias("other")), rows.filter("label < 3").select("vec_id")


@query("init_report", f"SELECT count(*) AS tokens, count(*) FILTER (hits > 0) AS from_cognates, count(*) FILTER (hits = 0) AS random_init, round(100.0 * count(*) FILTER (hits > 0) / greatest(count(*), 1), 6) AS rate, count(*) FILTER (linked > 1) AS multi FROM (SELECT token, count(k.vec_id) AS hits, count(*) AS linked FROM {_LINKS} LEFT JOIN (SELECT vec_id FROM embeddings WHERE label < 3) k ON other = k.vec_id GROUP BY token)")
def init_report(spark, d):
    links, known = _cognates(spark, d)
    return vectors.init_report(links, "token", "other", known, "vec_id")


@query("failed_tokens", f"SELECT DISTINCT token FROM {_LINKS} WHERE token NOT IN (SELECT token FROM {_LINKS} WHERE other IN (SELECT vec_id FROM embeddings WHERE label < 3))")
def failed_tokens(spark, d):
    links, known = _cognates(spark, d)
    return vectors.failed_tokens(links, "token", "other", known, "vec_id")


@query("expert_selector", "SELECT event_id, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS expert FROM events")
def expert_selector(spark, d):
    given = F.when(F.col("event_id") % 3 == 0, F.upper("event_type")).when((F.col("event_id") % 3 == 1) & (F.col("event_type") == "click"), "1").otherwise(F.concat(F.lit(" "), "event_type"))
    return table(spark, d, "events").select("event_id", X.expert_index(given, ["view", "click", "error", "signup", "purchase"]).alias("expert"))


_TRACE = """(SELECT user_id, event_id, CASE event_type WHEN 'signup' THEN 'mode: ' || CASE WHEN event_id % 2 = 0 THEN 'token' ELSE 'sequence' END WHEN 'purchase' THEN 'Showing Probabilities for Layer: layers.' || (event_id % 3)
  WHEN 'error' THEN 'case: Catalan ' || (event_id % 2) WHEN 'view' THEN 'to|k' || event_id || ' | 0.5 | 0.25 | 0.25' ELSE 'no row | x | y | z' END AS t FROM events)"""


@query(
    "routing_trace_parse",
    f"""WITH a AS (SELECT *, CASE WHEN t LIKE 'mode: %' THEN substr(t, 7) END AS m, CASE WHEN t LIKE 'case: %' THEN substr(t, 7) END AS c, CASE WHEN t LIKE 'Showing%' THEN substr(t, 34) END AS l FROM {_TRACE}),
    b AS (SELECT *, last_value(m IGNORE NULLS) OVER w AS mode, last_value(l IGNORE NULLS) OVER w AS layer, count(m) OVER w AS k FROM a WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)),
    d AS (SELECT *, coalesce(last_value(c IGNORE NULLS) OVER (PARTITION BY user_id, k ORDER BY event_id ROWS UNBOUNDED PRECEDING), 'French') AS "case" FROM b)
    SELECT user_id, mode, "case", layer, (row_number() OVER (PARTITION BY user_id, mode, "case", layer ORDER BY event_id) - 1)::INT AS "row", 'to|k' || event_id AS token, '0.5 0.25 0.25' AS gates FROM d WHERE layer IS NOT NULL AND t LIKE 'to|%'""",
)
def routing_trace_parse(spark, d):
    e, n = F.col("event_type"), F.col("event_id")
    text = (
        F.when(e == "signup", F.concat(F.lit("mode: "), F.when(n % 2 == 0, "token").otherwise("sequence")))
        .when(e == "purchase", F.concat(F.lit("Showing Probabilities for Layer: layers."), n % 3))
        .when(e == "error", F.concat(F.lit("case: Catalan "), n % 2))
        .when(e == "view", F.concat(F.lit("to|k"), n, F.lit(" | 0.5 | 0.25 | 0.25")))
        .otherwise("no row | x | y | z")
    )
    found = routing.parse_trace(table(spark, d, "events").select("user_id", "event_id", text.alias("t")), "event_id", "t", "user_id")
    return found.withColumn("gates", F.array_join(F.transform("gates", lambda g: g.cast("string")), " "))
