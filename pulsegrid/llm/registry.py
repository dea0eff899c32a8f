"""The queries of this subpackage, as ``__spark_entry__`` registers them."""

from __future__ import annotations

from . import bestfit, codes, decontaminate, divergence, html, jaccard, media, packing, pii, quality, secrets, tokens, toxicity

QUERIES = {
    "op1_media_columns": media.query,
    "op2_quality_crf": quality.query,
    "op3_secret_scan": secrets.query,
    "op4_token_counts": tokens.query,
    "op5_html_text": html.query,
    "op6_harmonic_packing": packing.query,
    "op7_benchmark_leaks": decontaminate.query,
    "op8_pii_surrogates": pii.query,
    "op9_jaccard_join": jaccard.query,
    "op10_toxicity": toxicity.query,
    "op11_best_fit": bestfit.query,
    "op12_vector_codes": codes.query,
    "op13_divergence_audit": divergence.query,
}
#: The others can't be said in SQL; their tests compare them with brute force, round trips or held-out labels.
ORACLE_SQL: dict[str, str] = {"op12_vector_codes": codes.ORACLE_SQL, "op13_divergence_audit": divergence.ORACLE_SQL}
