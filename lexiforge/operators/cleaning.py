"""Line cleaning, rule filters and the statuses that they give rows."""

from __future__ import annotations

from collections.abc import Callable

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X

# The edit marker and junk phrases of crawled pages.
EDIT_MARKER = r"(?iU)\[\s*modificar.*?\s*\]"
JUNK_PHRASES = [
    "modificar la font",
    "clicar sul ligam",
    "terminar lo procès de validacion",
    "vòstre comentari es a mand",
    "recebre per e",
    "anatz recebre per",
    "cal encara clicar",
    "dins lo navigador",
]
# Dialect rules; \b is made Unicode-aware by (?U).
REJECT_RULES = {
    "gascon_articles_eth_era": r"(?iU)\b(eth|era|eths|eras)\b",
    "aranese_contractions_deth": r"(?iU)\b(deth|dera|deths|deras)\b",
    "provençal_contractions_dau": r"(?iU)\b(dau|daus)\b",
    "gascon_indefinite_ua": r"(?iU)\bua\b",
    "gascon_enunciative_que_initial": r"(?iU)^\s*['\"(\-]*que(?:\s+|')(m|t|s|n|v|u|soi|sèm|es|ei|èra|eren)\b",
}
POSITIVE_RULES = {
    "articles_lo_la_los_las": r"(?iU)\b(lo|la|los|las)\b",
    "languedocien_contractions_del_pel_al": r"(?iU)\b(del|pel|al|dels|pels|als)\b",
    "classical_diacritics": r"[òèç]",
    "elision_apostrophe": r"(?U)\b([ldqsnmt])'",
    "interrogatives_norma_classica": r"(?iU)\b(ont|cossi|perque|quora|qual)\b",
}
# Sources that are not adapted, and outputs that are not accepted.
SOURCE_BLOCKLIST = [
    r"preu\s+(actual|de\s+les\s+accions)", r"cotitza\s+a\s+la\s+borsa", r"NASDAQ|NYSE|S&P\s*500", r"GDPR|CCPA|RGPD",
    r"Califòrnia|California|Texas|Florida", r"com\s+a\s+IA", r"no\s+puc\s+proporcionar\s+dades\s+en\s+temps\s+real",
    r"no\s+tinc\s+accés\s+a\s+internet", r"no\s+tinc\s+la\s+capacitat\s+de", r"https?://", r"\[(\d+)\]", r"font:\s",
    r"Merriam.Webster|Wikipedia|Britannica", r"Facebook|Instagram|Twitter|TikTok|YouTube", r"Amazon|Google|Apple|Microsoft",
    r"API\s+de\s+Google|OpenAI",
]
OUTPUT_BLOCKLIST = [
    r"https?://", r"www\.", r"\[(\d+)\]", r"Facebook|Instagram|Twitter|TikTok|YouTube", r"Merriam.Webster|Wikipedia|Britannica",
    r"California|Texas|Florida|CCPA|GDPR|RGPD", r"NASDAQ|NYSE", r"Amazon\.com|Google\.com", r"com\s+a\s+IA", r"coma\s+IA",
]


def cleaned_lines(text, junk: list[str] = JUNK_PHRASES, marker: str = EDIT_MARKER, min_words: int = 5) -> Column:
    """The lines of a text that stay: markers cut out, stripped, without junk phrases, of enough words."""
    lines = F.transform(F.split(X.col(text), "\n"), lambda line: X.strip(F.regexp_replace(line, marker, "")))

    def stays(line):
        keep = (line != "") & (X.word_count(line) >= min_words)
        for phrase in junk:
            keep = keep & ~F.contains(F.lower(line), F.lit(phrase))
        return keep

    return F.filter(lines, stays)


def clean_documents(docs: DataFrame, text_col: str = "text", **rules) -> DataFrame:
    """Documents with their cleaned text; those that lose every line go."""
    return docs.withColumn(text_col, F.array_join(cleaned_lines(text_col, **rules), "\n")).filter(F.col(text_col) != "")


def language_gate(lines: DataFrame, label_col: str, score_col: str, blocked: list[str], least: float = 0.8) -> DataFrame:
    """Drops rows whose label is blocked with a score above ``least``; unlabelled rows stay."""
    bad = F.col(label_col).isin(blocked) & (F.col(score_col) > least)
    return lines.filter(~F.coalesce(bad, F.lit(False)))


def rule_scores(docs: DataFrame, text_col: str, reject: dict[str, str], positive: dict[str, str], least: int = 1) -> DataFrame:
    """Adds rejects, positives (not looked for once rejected) and keep."""
    rejects = X.hits(text_col, reject)
    scored = docs.withColumn("rejects", rejects)
    scored = scored.withColumn("positives", F.when(F.size("rejects") == 0, X.hits(text_col, positive)).otherwise(F.array().cast("array<string>")))
    return scored.withColumn("keep", (F.size("rejects") == 0) & (F.size("positives") >= least))


def reason_counts(scored: DataFrame) -> DataFrame:
    """How often each reason dropped a row; a row may count under several."""
    reasons = F.when(F.size("rejects") > 0, F.col("rejects")).when(~F.col("keep"), F.array(F.lit("insufficient_positive_signals")))
    return scored.select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def without_matches(rows: DataFrame, columns: list[str], patterns: list[str], flags: str = "idU") -> DataFrame:
    """Rows in which no pattern is found, whatever the case, in the columns joined by spaces.

    A dot is anything but a line feed. Without U among the flags, case and classes are those of ASCII.
    """
    text = F.concat_ws(" ", *(F.coalesce(F.col(c), F.lit("")) for c in columns))
    return rows.filter(~text.rlike(f"(?{flags})" + "|".join(patterns)))


def without_literal(rows: DataFrame, columns: list[str], literal: str = "<unk>") -> DataFrame:
    return rows.filter(~F.contains(F.concat_ws("\0", *columns), F.lit(literal)))


@dataclass(frozen=True)
class PairRules:
    """What a minimal pair of a category must show."""

    name: str
    required_correct: list[str] = field(default_factory=list)
    required_incorrect: list[str] = field(default_factory=list)
    forbidden_correct: list[str] = field(default_factory=list)
    min_apostrophes: int = 0
    max_words: int = 24


# The markers of the categories.
_FOREIGN_ARTICLES = [" el ", " els ", " eth ", " era ", " eras ", " eths "]
PAIR_CATEGORIES = [
    PairRules("elision", [], [" se ", " de ", " que ", " lo ", " la "], [], 1),
    PairRules("articles", [" lo ", " la ", " los ", " las "], _FOREIGN_ARTICLES, _FOREIGN_ARTICLES),
    PairRules("contractions", [" al ", " del ", " pel ", " als ", " dels ", " pels "], [" a lo ", " de lo ", " per lo ", " a los ", " de los ", " per los "]),
    PairRules("object_clitics", [" lo ", " la ", " los ", " las ", " ne ", " n'", " i "]),
    PairRules("negation", [" pas", "non "]),
    PairRules("agreement"),
    PairRules("auxiliaries_tense", [" ai ", " as ", " a ", " avèm ", " son ", " es ", " èra ", " aviá "]),
    PairRules("languedocien_shibboleths", [" lo ", " la ", " los ", " las ", " aquò", " aquela", " aquel"], [], _FOREIGN_ARTICLES),
]


def pair_errors(rules: PairRules, source="source", correct="correct", incorrect="incorrect", explanation="explanation") -> Column:
    """All that is wrong with a pair, in a fixed order; an empty array accepts it."""
    source, explanation = (F.coalesce(X.squash(c), F.lit("")) for c in (source, explanation))
    correct, incorrect = (X.straight_quotes(F.coalesce(X.squash(c), F.lit(""))) for c in (correct, incorrect))
    checks = [
        (source == "", "missing source_fr"),
        (correct == "", "missing correct_oc"),
        (incorrect == "", "missing incorrect_oc"),
        (explanation == "", "missing explanation"),
        ((correct != "") & (F.lower(correct) == F.lower(incorrect)), "correct_oc and incorrect_oc are identical"),
        (X.apostrophes(correct) < rules.min_apostrophes, f"correct_oc has fewer than {rules.min_apostrophes} apostrophes"),
    ]
    if rules.required_correct:
        checks.append((~X.contains_any(correct, rules.required_correct), "correct_oc lacks required category marker"))
    if rules.required_incorrect:
        checks.append((~X.contains_any(incorrect, rules.required_incorrect), "incorrect_oc lacks required error marker"))
    if rules.forbidden_correct:
        checks.append((X.contains_any(correct, rules.forbidden_correct), "correct_oc contains forbidden interference marker"))
    checks += [
        (X.word_count(correct) > rules.max_words, "correct_oc is too long"),
        (X.word_count(incorrect) > rules.max_words, "incorrect_oc is too long"),
    ]
    return F.array_compact(F.array(*(F.when(wrong, F.lit(message)) for wrong, message in checks)))


def validated_pairs(pairs: DataFrame, categories: list[PairRules] = PAIR_CATEGORIES, category_col: str = "category") -> DataFrame:
    """Adds errors by each row's category; a category without rules is an error."""
    errors = F.array(F.lit("unknown category"))
    for rules in categories:
        errors = F.when(F.col(category_col) == rules.name, pair_errors(rules)).otherwise(errors)
    return pairs.withColumn("errors", errors)


def checked_pairs(rows: DataFrame, skip_review: bool = False) -> DataFrame:
    """Pairs ready for scoring: id, category, source, correct and incorrect must be there and the two sides differ,
    else an error names the pair. Missing phenomenon and source_lang get the category and "fr"; with
    ``skip_review`` pairs marked needs_manual_review go first."""
    if skip_review and "needs_manual_review" in rows.columns:
        rows = rows.filter(~F.coalesce(F.col("needs_manual_review"), F.lit(False)))
    name = F.coalesce(F.col("id").cast("string"), F.lit("?"))
    for c in ("id", "category", "source", "correct", "incorrect"):
        if c not in rows.columns:
            raise ValueError(f"pairs have no {c}")
        fault = F.raise_error(F.concat(F.lit(f"no {c} in pair "), name)).cast(rows.schema[c].dataType)
        rows = rows.withColumn(c, F.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "", fault).otherwise(F.col(c)))
    same = F.raise_error(F.concat(F.lit("identical sides in pair "), name)).cast("string")
    rows = rows.withColumn("correct", F.when(F.trim("correct") == F.trim("incorrect"), same).otherwise(F.col("correct")))
    for c, default in (("phenomenon", F.col("category")), ("source_lang", F.lit("fr"))):
        given = X.none_if_empty(X.strip(F.col(c))) if c in rows.columns else F.lit(None).cast("string")
        rows = rows.withColumn(c, F.coalesce(given, default))
    return rows


def plain_texts(rows: DataFrame, text: str = "text") -> DataFrame:
    """The rows themselves, if they are plain texts: prepared rows with labels, or rows without the text, are an error."""
    if "labels" in rows.columns:
        raise ValueError("rows with labels are prepared for instructions, not plain texts")
    if text not in rows.columns:
        raise ValueError(f"rows have no {text}")
    return rows


def with_language(rows: DataFrame, text: str, predict: Callable[[list[str]], list[tuple[str, float]]]) -> DataFrame:
    """Adds lang_label and lang_score by any predictor of batches of texts; null texts have neither."""

    @F.pandas_udf("label string, score double")
    def labelled(texts: pd.Series) -> pd.DataFrame:
        known = texts.notna()
        found = pd.DataFrame(predict(texts[known].tolist()), columns=["label", "score"], index=texts.index[known])
        return found.reindex(texts.index)

    return rows.withColumn("_l", labelled(F.col(text))).select(*(F.col(c) for c in rows.columns), F.col("_l.label").alias("lang_label"), F.col("_l.score").alias("lang_score"))


def marker_language(rows: DataFrame, text: str, markers: dict[str, list[str]]) -> DataFrame:
    """Adds lang_label and lang_score by marker words: the language with the most of them in the text (of equals the first
    by name) and its share of all that were found; null where there is none. Column expressions only."""
    names = sorted(markers)
    found = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b[\w']+\b"), F.lit(0))
    listed = F.create_map(*(F.lit(x) for name in names for word in markers[name] for x in (word, name)))
    # words become the names of their languages first, so a text is looked through once
    hits = F.array_compact(F.transform(found, lambda w: F.element_at(listed, w)))
    def _times(name: str) -> Column:
        return F.size(F.filter("_hits", lambda h: h == name))

    counts = F.array(*(_times(name) for name in names))
    counted = rows.withColumn("_hits", hits).withColumn("_counts", counts).withColumn("_top", F.array_max("_counts"))
    label = F.when(F.col("_top") > 0, F.get(F.array(*map(F.lit, names)), (F.array_position("_counts", F.col("_top")) - 1).cast("int")))
    return counted.withColumn("lang_label", label).withColumn("lang_score", F.when(F.col("_top") > 0, F.col("_top") / F.size("_hits"))).drop("_hits", "_counts", "_top")


def batched_map(rows: DataFrame, change: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Rows changed batch by batch; a batch may give more or fewer rows."""
    return rows.mapInPandas(lambda batches: map(change, batches), schema)


def batched_filter(rows: DataFrame, keep: Callable[[pd.DataFrame], pd.Series]) -> DataFrame:
    """Rows for which ``keep`` of their batch is true."""
    return rows.mapInPandas(lambda batches: (b[keep(b).astype(bool).to_numpy()] for b in batches), rows.schema)
