"""The queries of this subpackage, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from . import attribution, extraction, jaccard, langid, media, negatives, neighbours, packing, passages, runs, toxicity, unigram, urls

QUERIES = {
    "op1_ngram_jaccard_join": jaccard.query,
    "op2_media_columns": media.query,
    "op3_url_filters": urls.query,
    "op4_token_counts": attribution.query,
    "op5_packing": packing.query,
    "op6_nearest_neighbours": neighbours.query,
    "op7_suffix_array_dedup": passages.query,
    "op8_html_extraction": extraction.query,
    "op9_language_id": langid.query,
    "op10_sentencepiece": unigram.query,
    "op11_periodic_runs": runs.query,
    "op12_toxicity": toxicity.query,
    "op13_hard_negatives": negatives.query,
}
ORACLE: dict[str, str] = {"op3_url_filters": urls.ORACLE, "op13_hard_negatives": negatives.ORACLE}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
