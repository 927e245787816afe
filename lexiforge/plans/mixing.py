"""Queries of joins, unions, mixing and sequence preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import cleaning, dedup, generation, joins, sampling, sequences, statistics
from ..sources import readers
from .tables import sql_hash, sql_index, squash, strip, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
SEED = 42
_WORDS = "list_filter(regexp_split_to_array({0}, '[\\s\\p{{Z}}]+'), lambda w: w <> '')"
_IDS = "list_transform(" + _WORDS + ", lambda w: (('0x' || substr(md5(w), 1, 8))::BIGINT % 50000 + 1)::INT)"


def query(name: str, oracle: str | None = None):
    def register(f):
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return register


@query("tagged_union", "SELECT 'documents' AS src, doc_id AS item, lang FROM documents UNION ALL SELECT 'benchmark', item_id, NULL FROM benchmark UNION ALL SELECT 'conversations', conv_id, NULL FROM conversations")
def tagged_union(spark, d):
    return joins.tagged_union(
        {
            "documents": table(spark, d, "documents").select(F.col("doc_id").alias("item"), "lang"),
            "benchmark": table(spark, d, "benchmark").select(F.col("item_id").alias("item")),
            "conversations": table(spark, d, "conversations").select(F.col("conv_id").alias("item")),
        },
        "src",
    ).select("src", "item", "lang")


@query("union_distinct_norm", f"SELECT lower({squash('text')}) AS key, count(*) AS n FROM (SELECT text FROM documents UNION ALL SELECT text FROM benchmark) GROUP BY 1")
def union_distinct_norm(spark, d):
    both = table(spark, d, "documents").select("text").unionByName(table(spark, d, "benchmark").select("text"))
    return both.groupBy(dedup.text_key("text").alias("key")).agg(F.count("*").alias("n"))


@query("reply_pairs", "SELECT r.conv_id, r.turn, p.text AS instruction, r.text AS output FROM conversations r JOIN conversations p ON r.conv_id = p.conv_id AND r.turn = p.turn + 1 WHERE r.role = 'assistant' AND p.role = 'user'")
def reply_pairs(spark, d):
    return _replies(spark, d)


def _replies(spark, d):
    talk = table(spark, d, "conversations")
    here, above = F.concat_ws(":", "conv_id", "turn"), F.concat_ws(":", "conv_id", F.col("turn") - 1)
    messages = talk.withColumn("key", here).withColumn("parent", above)
    pairs = joins.reply_pairs(messages, "key", "parent", "text", F.col("role") == "user", F.col("role") == "assistant")
    key = F.split("key", ":")
    return pairs.select(key[0].cast("long").alias("conv_id"), key[1].cast("long").alias("turn"), "instruction", "output")


@query("dialogue_concat", "SELECT a.conv_id, a.turn, concat_ws(chr(10), nullif(trim(a.text), ''), nullif(trim(b.text), '')) AS text FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.turn % 2 = 0 AND concat_ws(chr(10), nullif(trim(a.text), ''), nullif(trim(b.text), '')) <> ''")
def dialogue_concat(spark, d):
    talk = table(spark, d, "conversations")
    b = talk.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("second"))
    both = talk.filter("turn % 2 = 0").join(b, ["conv_id", "turn"], "left")
    text = F.concat_ws("\n", X.none_if_empty(X.strip("text")), X.none_if_empty(X.strip("second")))
    return both.select("conv_id", "turn", text.alias("text")).filter("text <> ''")


@query("alpaca_normalize", f"SELECT conv_id, turn, {strip('role')} AS instruction, {strip('text')} AS output FROM conversations WHERE {strip('role')} <> '' AND {strip('text')} <> ''")
def alpaca_normalize(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", X.strip("role").alias("instruction"), X.strip("text").alias("output")).filter("instruction <> '' AND output <> ''")


@query("parallel_align", "SELECT a.k, a.t AS en, b.t AS fr FROM (SELECT row_number() OVER (ORDER BY doc_id) AS k, text AS t FROM documents WHERE lang = 'en') a JOIN (SELECT row_number() OVER (ORDER BY doc_id) AS k, text AS t FROM documents WHERE lang = 'fr') b USING (k)")
def parallel_align(spark, d):
    def part(lang):
        rows = table(spark, d, "documents").filter(F.col("lang") == lang).select("doc_id", "text")
        numbered, _ = sampling.numbered(rows.select("doc_id"), "k", "doc_id")
        return numbered.join(rows, "doc_id").select((F.col("k") + 1).alias("k"), "text")

    return joins.aligned({"en": part("en"), "fr": part("fr")}, "k", check=False).filter("en IS NOT NULL AND fr IS NOT NULL")


@query("fallback_join", "SELECT l.l_partkey, l.l_linenumber, count(*) AS n, max(coalesce(a.p_size, b.p_size)) AS p_size FROM lineitem l LEFT JOIN (SELECT * FROM part WHERE p_partkey % 3 = 0) a ON l.l_partkey = a.p_partkey LEFT JOIN (SELECT * FROM part WHERE p_partkey % 3 = 0) b ON l.l_partkey - l.l_partkey % 3 = b.p_partkey GROUP BY 1, 2")
def fallback_join(spark, d):
    known = table(spark, d, "part").filter("p_partkey % 3 = 0").select("p_partkey", "p_size")
    items = table(spark, d, "lineitem").groupBy("l_partkey", "l_linenumber").agg(F.count("*").alias("n"))
    return joins.fallback_lookup(items, "l_partkey", known, "p_partkey", "p_size", F.col("l_partkey") - F.col("l_partkey") % 3)


@query("resume_anti_join", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti_join(spark, d):
    return joins.not_done(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")


@query("vocab_anti", "SELECT DISTINCT w AS word FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents) WHERE w NOT IN (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) FROM benchmark)")
def vocab_anti(spark, d):
    def vocabulary(name):
        return table(spark, d, name).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word")).distinct()

    return joins.not_done(vocabulary("documents"), vocabulary("benchmark"), "word")


@query("model_pairs", "SELECT a.n_name AS left, b.n_name AS right FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey".replace(" AS left", ' AS "left"').replace(" AS right", ' AS "right"'))
def model_pairs(spark, d):
    return joins.ordered_pairs(table(spark, d, "nation"), "n_name", "n_nationkey")


_MARK = "len(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_'']+'), lambda w: w IN ({0})))::BIGINT"


@query("marker_probe", f"SELECT doc_id, {_MARK.format(chr(39) + 'les' + chr(39) + ', ' + chr(39) + 'des' + chr(39))} AS fr, {_MARK.format(chr(39) + 'the' + chr(39) + ', ' + chr(39) + 'and' + chr(39))} AS en FROM documents")
def marker_probe(spark, d):
    return joins.marker_counts(table(spark, d, "documents").select("doc_id", "text"), "text", {"fr": ["les", "des"], "en": ["the", "and"]}).select("doc_id", "fr", "en")


_PAIRS = [("en", "fr"), ("fr", "en"), ("en", "de"), ("de", "en"), ("es", "fr"), ("fr", "es")]
_SEG = f"""(SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS r,
   list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace({strip('text')}, '([.!?])\\s+', '\\1' || chr(1), 'g'), '\\n+', chr(1), 'g'), '([;:])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: {strip('s')}), lambda s: s <> '') AS c,
   list_filter(list_transform(regexp_split_to_array({strip('text')}, '\\s*,\\s*'), lambda s: {strip('s')}), lambda s: s <> '') AS k FROM documents)"""


@query(
    "codeswitch",
    f"""WITH s AS (SELECT lang, doc_id, r, CASE WHEN len(c) < 2 THEN k ELSE c END AS seg FROM {_SEG}), n AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang),
    t AS (SELECT a AS attempt, {sql_index(6, SEED, "'pair'", 'a')} + 1 AS p FROM (SELECT unnest(range(greatest(30 * round_even(0.04 * count(*), 0), 100)::BIGINT)) AS a FROM documents)),
    u AS (SELECT attempt, ['en','fr','en','de','es','fr'][p] AS al, ['fr','en','de','en','fr','es'][p] AS il FROM t),
    v AS (SELECT u.*, {sql_index('an.n', SEED, "'anchor'", 'attempt')} AS ar, {sql_index('dn.n', SEED, "'donor'", 'attempt')} AS dr FROM u JOIN n an ON an.lang = al JOIN n dn ON dn.lang = il),
    w AS (SELECT attempt, a.doc_id AS anchor, b.doc_id AS donor, al AS anchor_lang, il AS inserted_lang, a.seg AS x, b.seg AS y, ({sql_index('(len(a.seg) - 1)', SEED, "'place'", 'attempt')} + 1)::INT AS i, {sql_index('len(b.seg)', SEED, "'segment'", 'attempt')} + 1 AS j
      FROM v JOIN s a ON a.lang = al AND a.r = ar JOIN s b ON b.lang = il AND b.r = dr WHERE len(a.seg) >= 2 AND len(b.seg) >= 1),
    z AS (SELECT attempt, anchor, donor, anchor_lang, inserted_lang, i AS insert_after_segment, array_to_string(list_concat(list_concat(x[1:i], [y[j]]), x[i+1:]), ' ') AS text FROM w)
    SELECT * EXCLUDE (f) FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY attempt) AS f FROM z) WHERE f = 1 QUALIFY row_number() OVER (ORDER BY attempt) <= (SELECT round_even(0.04 * count(*), 0) FROM documents)""",
)
def codeswitch(spark, d):
    """As many mixed texts as 4 in 100 documents."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "text")
    return joins.code_switched(docs, "lang", "text", "doc_id", _PAIRS, round(0.04 * docs.count()), SEED)


@query("repeat_mix", "SELECT doc_id, source, unnest(range(1, CASE source WHEN 'src1' THEN 3 WHEN 'src2' THEN 2 ELSE 1 END + 1))::INT AS copy FROM documents")
def repeat_mix(spark, d):
    return sequences.repeated(table(spark, d, "documents").select("doc_id", "source"), "source", {"src1": 3, "src2": 2})


_TEMPLATES = ["Write a sentence.", "Continue the text.", "Compose a passage."]


@query("template_assign", f"SELECT doc_id, ['Write a sentence.', 'Continue the text.', 'Compose a passage.'][{sql_index(3, SEED, 'doc_id')} + 1] AS instruction FROM documents")
def template_assign(spark, d):
    return sequences.template_choice(table(spark, d, "documents").select("doc_id"), _TEMPLATES, "doc_id", SEED)


@query(
    "curriculum_merge",
    f"""SELECT ['Write a sentence.', 'Continue the text.', 'Compose a passage.'][{sql_index(3, SEED, 'doc_id')} + 1] AS instruction, '' AS input, text AS output, 'synth' AS source, source AS source_type FROM documents
    UNION ALL SELECT p.text, '', r.text, 'alpaca', NULL FROM conversations r JOIN conversations p ON r.conv_id = p.conv_id AND r.turn = p.turn + 1 WHERE r.role = 'assistant' AND p.role = 'user'""",
)
def curriculum_merge(spark, d):
    texts = sequences.template_choice(table(spark, d, "documents"), _TEMPLATES, "doc_id", SEED)
    synth = texts.select("instruction", F.lit("").alias("input"), F.col("text").alias("output"), F.lit("synth").alias("source"), F.col("source").alias("source_type"))
    pairs = _replies(spark, d).select("instruction", F.lit("").alias("input"), "output", F.lit("alpaca").alias("source"))
    return synth.unionByName(pairs, allowMissingColumns=True)


@query(
    "router_dataset",
    f"""WITH b AS (SELECT count(*) AS base FROM documents WHERE lang = 'es'), t(lang, mult) AS (VALUES ('es', 1.0), ('fr', 0.5), ('de', 0.25)),
    r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {sql_hash(SEED, 'doc_id')}, doc_id) AS k FROM documents)
    SELECT r.doc_id, r.lang FROM r JOIN t USING (lang) CROSS JOIN b WHERE k <= round_even(base * mult, 0)""",
)
def router_dataset(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    base = docs.filter("lang = 'es'").agg(F.count("*").alias("base"))
    wanted = spark.createDataFrame([("es", 1.0), ("fr", 0.5), ("de", 0.25)], "lang string, mult double").crossJoin(F.broadcast(base))
    wanted = wanted.select("lang", F.bround(F.col("base") * F.col("mult")).alias("target"))
    ranked = sampling.ranked(docs.filter(F.col("lang").isin("es", "fr", "de")), "lang", SEED, "doc_id")
    return ranked.join(F.broadcast(wanted), "lang").filter("rank <= target").select("doc_id", "lang")


@query("format_prompt", "SELECT conv_id, turn, CASE WHEN turn % 2 = 1 THEN '### Instruction:' || chr(10) || role || chr(10) || chr(10) || '### Input:' || chr(10) || text ELSE '### Instruction:' || chr(10) || role END || chr(10) || chr(10) || '### Response:' || chr(10) || text AS prompt FROM conversations")
def format_prompt(spark, d):
    given = F.when(F.col("turn") % 2 == 1, F.col("text")).otherwise("")
    return table(spark, d, "conversations").select("conv_id", "turn", X.alpaca_prompt("role", given, "text").alias("prompt"))


@query("json_props", "SELECT event_id, (props->>'$.k')::BIGINT AS k, '{\"k\":' || (props->>'$.k') || '}' AS again FROM events")
def json_props(spark, d):
    read = F.from_json("props", "k long")
    return table(spark, d, "events").select("event_id", read["k"].alias("k"), F.to_json(F.struct(read["k"].alias("k"))).alias("again"))


@query("tokenize_truncate", f"SELECT doc_id, array_to_string({_IDS.format('text')}[1:128], ' ') AS ids, CASE lang WHEN 'fr' THEN 0 WHEN 'es' THEN 1 ELSE -100 END AS expert_target FROM documents")
def tokenize_truncate(spark, d):
    rows = sequences.tokenized(table(spark, d, "documents"), "text", sequences.hashed_words(), 128, "lang", {"fr": 0, "es": 1})
    return rows.select("doc_id", F.array_join(F.transform("input_ids", lambda x: x.cast("string")), " ").alias("ids"), "expert_target")


_PAIR_SQL = "SELECT r.conv_id, r.turn, p.text AS prompt, r.text AS output FROM conversations r JOIN conversations p ON r.conv_id = p.conv_id AND r.turn = p.turn + 1 WHERE r.role = 'assistant' AND p.role = 'user'"
_MASK_SQL = f"""SELECT conv_id, turn, CASE WHEN len(f) < 48 THEN list_append(f, 0) ELSE f END AS ids, least(len(pi), len(f)) AS p FROM (
  SELECT conv_id, turn, {_IDS.format('prompt')} AS pi, list_concat({_IDS.format('prompt')}, {_IDS.format('output')})[1:48] AS f FROM ({_PAIR_SQL}))"""


def _masked(spark, d):
    pairs = _replies(spark, d)
    return sequences.masked_labels(pairs, "instruction", "output", sequences.hashed_words(), 48, 0)


def _joined(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), " ").alias(c)


@query("mask_labels", f"SELECT conv_id, turn, array_to_string(ids, ' ') AS input_ids, array_to_string(list_concat(list_transform(range(p), lambda i: -100), ids[p+1:]), ' ') AS labels FROM ({_MASK_SQL}) WHERE len(ids) > p")
def mask_labels(spark, d):
    return _masked(spark, d).select("conv_id", "turn", _joined("input_ids"), _joined("labels"))


@query("mask_filter", f"SELECT conv_id, turn, len(ids) - p AS learned FROM ({_MASK_SQL}) WHERE len(ids) > p")
def mask_filter(spark, d):
    return _masked(spark, d).select("conv_id", "turn", F.size(F.filter("labels", lambda x: x != sequences.IGNORE)).cast("long").alias("learned"))


@query(
    "pad_clamp",
    f"""WITH m AS (SELECT *, row_number() OVER (ORDER BY conv_id, turn) - 1 AS k FROM ({_MASK_SQL}) WHERE len(ids) > p), b AS (SELECT *, k // 8 AS batch, max(len(ids)) OVER (PARTITION BY k // 8) AS size FROM m)
    SELECT conv_id, turn, batch, array_to_string(list_concat(ids, list_transform(range(size - len(ids)), lambda i: 0)), ' ') AS input_ids,
      array_to_string(list_concat(list_concat(list_transform(range(p), lambda i: -100), list_transform(ids[p+1:], lambda x: least(x, 29999))), list_transform(range(size - len(ids)), lambda i: -100)), ' ') AS labels FROM b""",
)
def pad_clamp(spark, d):
    rows = _masked(spark, d)
    counted, _ = sampling.numbered(rows, "k", "conv_id", "turn")
    return sequences.padded(counted, "k", 8, 0, 30_000).select("conv_id", "turn", F.col("batch").cast("long").alias("batch"), _joined("input_ids"), _joined("labels"))


@query(
    "prefix_stream",
    f"""WITH l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents),
    s AS (SELECT doc_id, line_no, len({_WORDS.format('line')})::BIGINT AS n FROM l)
    SELECT doc_id, line_no, (coalesce(sum(n + 4) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 3)::BIGINT AS "begin", (coalesce(sum(n + 4) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 3 + n)::BIGINT AS "end" FROM s""",
)
def prefix_stream(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return sequences.prefix_stream(lines.withColumn("line_no", F.col("line_no").cast("long")), "doc_id", "line_no", "line", 3, 1).select("doc_id", "line_no", "begin", "end")


@query(
    "sliding_windows",
    """WITH w AS (SELECT doc_id, n_chars AS total, unnest(range(0, n_chars, 512)) AS b FROM documents), e AS (SELECT *, least(b + 2048, total) AS e, lag(least(b + 2048, total), 1, 0) OVER (PARTITION BY doc_id ORDER BY b) AS prev FROM w),
    k AS (SELECT * FROM e WHERE b = 0 OR prev < total) SELECT doc_id, b // 512 AS "window", b AS "begin", e AS "end", CASE WHEN e - prev < e - b THEN e - prev ELSE e - b - 1 END AS scored FROM k""",
)
def sliding_windows(spark, d):
    return sequences.sliding_windows(table(spark, d, "documents").select("doc_id", F.col("n_chars").alias("total")), "total", 512, 2048).select("doc_id", "window", "begin", "end", "scored")


@query("pack_sequences", "SELECT doc_id, floor(coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 4096)::BIGINT AS sequence FROM documents")
def pack_sequences(spark, d):
    return sequences.packed(table(spark, d, "documents").select("doc_id", "source", "n_chars"), "source", "doc_id", "n_chars", 4096).select("doc_id", "sequence")


_FREQ = "SELECT word, count(*) AS n, min(doc_id) AS first_doc FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word, doc_id FROM documents) GROUP BY word"
_FRAG_SQL = f"""SELECT token, min(pl) AS place FROM (SELECT unnest([word, upper(substr(word, 1, 1)) || lower(substr(word, 2))]) AS token, unnest([2 * p, 2 * p + 1]) AS pl FROM (
  SELECT word, row_number() OVER (ORDER BY n DESC, first_doc, word) AS p FROM ({_FREQ}) WHERE n >= 5 AND length(word) >= 4 ORDER BY p LIMIT 300)) GROUP BY token ORDER BY place LIMIT 300"""


def _fragmented(spark, d):
    counts = statistics.word_frequency(table(spark, d, "documents"), "text", "doc_id", "[a-z]+")
    return sequences.fragmented_words(counts, 5, 4, 300)


@query("fragmented_words", _FRAG_SQL)
def fragmented_words(spark, d):
    return _fragmented(spark, d).withColumn("place", F.col("place").cast("long"))


@query("vocab_candidates", f"SELECT token, min(r) AS rank FROM (SELECT token, place + 1000 AS r FROM ({_FRAG_SQL}) UNION ALL SELECT * FROM (VALUES ('l''', 0), ('tion', 1), ('the', 2))) WHERE token NOT IN (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) FROM benchmark) GROUP BY token")
def vocab_candidates(spark, d):
    listed = spark.createDataFrame([("l'", 0), ("tion", 1), ("the", 2)], "token string, rank long")
    found = _fragmented(spark, d).select("token", (F.col("place") + 1000).alias("rank"))
    known = table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("token")).distinct()
    return joins.not_done(listed.unionByName(found), known, "token").groupBy("token").agg(F.min("rank").alias("rank"))


_BYTE_LIST = "[" + ", ".join("'" + c.replace("'", "''") + "'" for c in sequences.byte_characters()) + "]"


@query("byte_level_encode", f"SELECT doc_id, array_to_string(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ({_BYTE_LIST})[('0x' || h)::INT + 1]), '') AS encoded FROM documents")
def byte_level_encode(spark, d):
    return table(spark, d, "documents").select("doc_id", sequences.byte_level("text").alias("encoded"))


@query("tokenizer_report")
def tokenizer_report(spark, d):
    """By language: documents, round-trip mismatches, mean fertility, high ones, byte artefacts of a public tokenizer."""
    import public_tokenizers

    tokens = sequences.library_tokens(table(spark, d, "documents").select("doc_id", "lang", "text"), "text", public_tokenizers.path("byte_bpe_50k.json"))
    counts = [F.count_if(c).alias(f"n_{c}") for c in ("mismatch", "high", "artefact")]
    return sequences.tokenizer_checks(tokens, "text").groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg("fertility"), 6).alias("fertility"), *counts)


_GIVEN_SQL = "SELECT *, CASE WHEN turn % 3 = 0 THEN text WHEN turn % 3 = 1 THEN ' ' END AS a, CASE WHEN turn % 2 = 1 THEN text ELSE '' END AS b, string_split(text, ' ') AS t FROM conversations"


@query("sentence_fallback", f"SELECT conv_id, turn, coalesce(nullif({strip('a')}, ''), nullif({strip('b')}, ''), {strip('array_to_string(t, chr(32))')}) AS text FROM ({_GIVEN_SQL})")
def sentence_fallback(spark, d):
    talk = table(spark, d, "conversations")
    a = F.when(F.col("turn") % 3 == 0, F.col("text")).when(F.col("turn") % 3 == 1, " ")
    rows = talk.select("conv_id", "turn", a.alias("text"), F.when(F.col("turn") % 2 == 1, F.col("text")).otherwise("").alias("sentence"), F.split("text", " ").alias("tokens"))
    return rows.select("conv_id", "turn", X.sentence_of(rows.columns).alias("text"))


@query("map_key_whitelist", "SELECT event_id, 'k=' || (props->>'$.k') AS kept, 'event,user' AS dropped FROM events")
def map_key_whitelist(spark, d):
    given = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("event"), F.col("event_type")))
    rows = table(spark, d, "events").select("event_id", given.alias("m"))
    kept = F.array_join(F.transform(F.map_entries(X.kept_keys("m", ["k"])), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return rows.select("event_id", kept.alias("kept"), F.array_join(X.dropped_keys("m", ["k"]), ",").alias("dropped"))


@query("checked_pairs", "SELECT conv_id || ':' || turn AS id, 'turn ' || (turn % 2) AS category, p AS correct, o AS incorrect, 'turn ' || (turn % 2) AS phenomenon, 'fr' AS source_lang FROM (SELECT conv_id, turn, prompt AS p, output AS o FROM (" + _PAIR_SQL + ")) WHERE turn % 5 <> 0 AND trim(p) <> trim(o) AND trim(p) <> '' AND trim(o) <> ''")
def checked_pairs(spark, d):
    pairs = _replies(spark, d).filter("trim(instruction) <> trim(output) AND trim(instruction) <> '' AND trim(output) <> ''")
    rows = pairs.select(
        F.concat_ws(":", "conv_id", "turn").alias("id"), F.concat(F.lit("turn "), F.col("turn") % 2).alias("category"), F.lit("x").alias("source"),
        F.col("instruction").alias("correct"), F.col("output").alias("incorrect"), (F.col("turn") % 5 == 0).alias("needs_manual_review"),
    )
    return cleaning.checked_pairs(rows, skip_review=True).select("id", "category", "correct", "incorrect", "phenomenon", "source_lang")


@query("token_texts", "SELECT conv_id, turn, array_to_string(list_transform(list_filter(regexp_split_to_array(role, ''), lambda c: c <> ''), lambda c: chr(39) || c || chr(39)), ' ') AS tokens FROM conversations")
def token_texts(spark, d):
    """What single bytes of a role add to its decoded text."""
    pairs = F.regexp_extract_all(F.hex(F.encode("role", "UTF-8")), F.lit(".."), F.lit(0))
    tokens = sequences.token_texts(F.transform(pairs, F.unhex))
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(tokens, " ").alias("tokens"))


@query(
    "byte_token_texts",
    """SELECT conv_id, turn, array_to_string(list_transform(list_filter(regexp_split_to_array(text, ''), lambda c: c <> ''),
      lambda c: repeat('<byte> ', strlen(c) - 1) || CASE c WHEN chr(10) THEN chr(39) || '\\n' || chr(39) WHEN chr(9) THEN chr(39) || '\\t' || chr(39) WHEN chr(92) THEN chr(39) || '\\\\' || chr(39) WHEN chr(39) THEN '"' || chr(39) || '"' ELSE chr(39) || c || chr(39) END), ' ') AS tokens FROM conversations""",
)
def byte_token_texts(spark, d):
    """What each byte of a text adds to what was decoded before it: characters of several bytes are incomplete at first."""
    pairs = F.regexp_extract_all(F.hex(F.encode("text", "UTF-8")), F.lit(".."), F.lit(0))
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(sequences.token_texts(F.transform(pairs, F.unhex)), " ").alias("tokens"))


@query(
    "aligned_lines",
    """SELECT a.k, a.t AS prediction, b.t AS reference FROM (SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS k, text AS t FROM conversations WHERE role = 'assistant') a
    JOIN (SELECT row_number() OVER (ORDER BY conv_id DESC, turn DESC) - 1 AS k, text AS t FROM conversations WHERE role = 'assistant') b USING (k)""",
)
def aligned_lines(spark, d):
    """Two files of as many lines side by side, by line number; a line without its counterpart would be an error."""
    said = table(spark, d, "conversations").filter("role = 'assistant'").select("conv_id", "turn", "text")
    forward, n = sampling.numbered(said.select("conv_id", "turn"), "k", "conv_id", "turn")
    lines = forward.join(said, ["conv_id", "turn"])
    return joins.aligned({"prediction": lines.select("k", "text"), "reference": lines.select((F.lit(n - 1) - F.col("k")).alias("k"), "text")}, "k")


@query(
    "label_forms",
    """SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '^_|_$', '', 'g') AS slug, CASE WHEN length(p_name) > 11 THEN substr(p_name, 1, 11) || '...' ELSE p_name END AS short,
      upper(substr(p_name, 1, 1)) || lower(substr(p_name, 2)) AS capital, replace(p_name, ' ', chr(10)) AS unescaped, p_name AS inside, (ceil(p_size / 64.0) * 64)::BIGINT AS aligned, p_name || chr(10) || 'x' AS lines FROM part""",
)
def label_forms(spark, d):
    fenced = F.concat(F.lit("```json\n"), "p_name", F.lit("\n```"))
    return table(spark, d, "part").select(
        "p_partkey", X.slug("p_name").alias("slug"), X.shorten("p_name").alias("short"), X.capitalize("p_name").alias("capital"),
        X.unescape(F.replace("p_name", F.lit(" "), F.lit(r"\n"))).alias("unescaped"), X.strip_code_fence(fenced).alias("inside"), X.aligned_size("p_size").alias("aligned"),
        X.line_key(F.concat(F.lit(" "), "p_name", F.lit("\r\nx "))).alias("lines"),
    )


@query("ordered_batches", "SELECT (k // 50)::BIGINT AS batch, string_agg(doc_id, ' ' ORDER BY k) AS ids FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS k FROM labels) GROUP BY 1")
def ordered_batches(spark, d):
    placed, _ = sampling.numbered(table(spark, d, "labels").select("doc_id"), "k", "doc_id")
    found = generation.batches(placed, "k", "doc_id", 50)
    return found.select(F.col("batch").cast("long").alias("batch"), F.array_join(F.transform("values", lambda v: v.cast("string")), " ").alias("ids"))


@query("json_explode", "SELECT conv_id, turn, unnest([role, 'x']) AS \"A\", unnest(['y', text]) AS \"B\" FROM conversations")
def json_explode(spark, d):
    pairs = F.array(F.struct(F.col("role").alias("A"), F.lit("y").alias("B")), F.struct(F.lit("x").alias("A"), F.col("text").alias("B")))
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.to_json(pairs).alias("j"))
    return generation.flattened(rows, "j", "A:string,B:string").select("conv_id", "turn", "A", "B")


@query("json_objects", "SELECT props || '' AS \"object\", true AS ok FROM events UNION ALL SELECT '{\"n\":' || event_id || '}', true FROM events UNION ALL SELECT '{broken', false FROM events WHERE event_id % 10 = 0".replace("props || ''", "replace(props, ' ', '')"))
def json_objects(spark, d):
    """Two objects on every line, and something broken behind some of them."""
    rest = F.when(F.col("event_id") % 10 == 0, "{broken").otherwise("")
    lines = table(spark, d, "events").select(F.concat("props", F.lit(' {"n": '), "event_id", F.lit("}"), rest).alias("line"))
    found = readers.split_objects(lines)
    return found.select(F.replace("object", F.lit(" "), F.lit("")).alias("object"), "ok")


@query(
    "json_objects_kept",
    """SELECT event_id, 0 AS place, replace(props, ' ', '') AS "object", true AS ok FROM events UNION ALL SELECT event_id, 1, '{"n":' || event_id || '}', true FROM events
    UNION ALL SELECT event_id, 2, '{broken', false FROM events WHERE event_id % 10 = 0""",
)
def json_objects_kept(spark, d):
    """The same objects, each beside the event that it is of."""
    rest = F.when(F.col("event_id") % 10 == 0, "{broken").otherwise("")
    rows = table(spark, d, "events").select("event_id", F.concat("props", F.lit(' {"n": '), "event_id", F.lit("}"), rest).alias("line"))
    return readers.objects_of(rows).select("event_id", "place", F.replace("object", F.lit(" "), F.lit("")).alias("object"), "ok")


@query("fallback_targets", f"SELECT coalesce(nullif({strip('a')}, ''), {strip('text')}) AS text, 'flores' AS source_type FROM (SELECT *, CASE WHEN turn % 2 = 0 THEN role END AS a FROM conversations) WHERE coalesce(nullif({strip('a')}, ''), {strip('text')}) NOT IN ('', 'nan')")
def fallback_targets(spark, d):
    rows = table(spark, d, "conversations").withColumn("target_text", F.when(F.col("turn") % 2 == 0, F.col("role")))
    return readers.target_texts(rows, "flores")


@query("default_categories", f"SELECT {strip('text')} AS text, CASE WHEN turn % 3 = 0 THEN role ELSE 'stress' END AS category FROM conversations WHERE {strip('text')} <> ''")
def default_categories(spark, d):
    rows = table(spark, d, "conversations").withColumn("category", F.when(F.col("turn") % 3 == 0, F.col("role")).when(F.col("turn") % 3 == 1, " "))
    return readers.categorised_texts(rows, "stress")


@query("split_concat", "SELECT o_orderkey, o_totalprice, CASE o_orderstatus WHEN 'F' THEN 'train' WHEN 'O' THEN 'dev' ELSE 'test' END AS split FROM orders")
def split_concat(spark, d):
    orders = table(spark, d, "orders")
    parts = {name: orders.filter(keep).select("o_orderkey", "o_totalprice") for name, keep in (("train", "o_orderstatus = 'F'"), ("dev", "o_orderstatus = 'O'"), ("test", "o_orderstatus NOT IN ('F', 'O')"))}
    return readers.all_splits(parts)
