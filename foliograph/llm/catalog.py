"""The queries of this subpackage, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from . import chat_format, html_render, lexical_search, license_scan, media_columns, merkle_manifest, neighbour_search, quality_classifier, secret_scan, sequence_packing, simhash_dedup, source_mixing, token_counts

QUERIES = {
    "op1_source_mixing": source_mixing.query,
    "op2_sequence_packing": sequence_packing.query,
    "op3_simhash_dedup": simhash_dedup.query,
    "op4_html_render": html_render.query,
    "op5_chat_format": chat_format.query,
    "op6_quality_classifier": quality_classifier.query,
    "op7_license_scan": license_scan.query,
    "op8_media_columns": media_columns.query,
    "op9_neighbour_search": neighbour_search.query,
    "op10_token_counts": token_counts.query,
    "op11_merkle_manifest": merkle_manifest.query,
    "op12_secret_scan": secret_scan.query,
    "op13_lexical_search": lexical_search.query,
}

ORACLES: dict[str, str] = {"op5_chat_format": chat_format.ORACLE, "op11_merkle_manifest": merkle_manifest.ORACLE, "op13_lexical_search": lexical_search.ORACLE}
