"""Queries of the training-data operators and their DuckDB equivalents."""

from __future__ import annotations

from . import decontamination, fill_middle, html_text, jaccard_join, language_id, lm_scoring, media, mixing, nearest, secrets, sharding, time_partitions, toxicity

QUERIES = {
    "op1_language_id": language_id.query,
    "op2_toxicity": toxicity.query,
    "op3_html_extraction": html_text.query,
    "op4_decontamination": decontamination.query,
    "op5_secret_scan": secrets.query,
    "op6_media_fingerprints": media.query,
    "op7_source_mixing": mixing.query,
    "op8_sharding": sharding.query,
    "op9_lm_scoring": lm_scoring.query,
    "op10_ngram_jaccard_join": jaccard_join.query,
    "op11_nearest_neighbours": nearest.query,
    "op12_fill_middle": fill_middle.query,
    "op13_time_partitions": time_partitions.query,
}
ORACLES = {
    "op7_source_mixing": mixing.oracle(),
    "op12_fill_middle": fill_middle.oracle(),
}
