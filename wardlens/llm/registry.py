"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import decontamination, katz, near_dedup, packing, pii, quality_neighbours, quality_rules, token_files, toxicity, url_filters

QUERIES = {
    "op1_token_files": token_files.query,
    "op2_packing": packing.query,
    "op4_quality_rules": quality_rules.query,
    "op3_toxicity": toxicity.query,
    "op5_pii": pii.query,
    "op6_quality_neighbours": quality_neighbours.query,
    "op7_decontamination": decontamination.query,
    "op8_url_filters": url_filters.query,
    "op9_katz": katz.query,
    "op10_near_dedup": near_dedup.query,
}
ORACLE = {
    "op10_near_dedup": near_dedup.sql(),
    "op4_quality_rules": quality_rules.sql(),
    "op7_decontamination": decontamination.sql(),
    "op8_url_filters": url_filters.sql(),
}
