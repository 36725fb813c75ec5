"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import html_text, kneser_ney, licenses, media, minhash_dedup, packing, quality_rules, substring_dedup, tokens, url_filters

QUERIES = {
    "op1_kneser_ney": kneser_ney.query,
    "op2_media_columns": media.query,
    "op3_license_scan": licenses.query,
    "op4_packing": packing.query,
    "op5_html_text": html_text.query,
    "op6_minhash_dedup": minhash_dedup.query,
    "op7_substring_dedup": substring_dedup.query,
    "op8_url_filters": url_filters.query,
    "op9_bpe": tokens.query,
    "op10_quality_rules": quality_rules.query,
}

ORACLES = {"op8_url_filters": url_filters.ORACLE_SQL, "op10_quality_rules": quality_rules.ORACLE_SQL}
