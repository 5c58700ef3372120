"""The queries of this subpackage and their DuckDB equivalents."""

from __future__ import annotations

from tarn.llm import fingerprint, gif, html_text, mixing, near_dedup, packing, quality, toxicity, url_filter, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_quality_classifier": quality.op2_quality_classifier,
    "op3_best_fit_packing": packing.op3_best_fit_packing,
    "op4_url_filters": url_filter.op4_url_filters,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_near_dedup": near_dedup.op6_near_dedup,
    "op7_mixing": mixing.op7_mixing,
    "op8_gif": gif.op8_gif,
    "op9_fingerprints": fingerprint.op9_fingerprints,
    "op10_html_extraction": html_text.op10_html_extraction,
}

ORACLE_SQL: dict[str, str] = {
    "op1_warc": warc.ORACLE,
    "op6_near_dedup": near_dedup.ORACLE,
    "op7_mixing": mixing.ORACLE,
}
