"""The queries of the corpus operators and their SQL, for the entry module."""

from __future__ import annotations

from faturaflow.llm import bpe, jaccard_join, katz, language, mixing, pivot_index, quality_model, quality_rules, substring_dedup, toxicity

QUERIES = {
    "op1_katz_backoff": katz.query,
    "op2_jaccard_join": jaccard_join.query,
    "op3_substring_dedup": substring_dedup.query,
    "op4_quality_model": quality_model.query,
    "op5_quality_rules": quality_rules.query,
    "op6_pivot_index": pivot_index.query,
    "op7_toxicity": toxicity.query,
    "op8_source_mixing": mixing.query,
    "op9_language_id": language.query,
    "op10_bpe": bpe.query,
}
SQL = {
    "op2_jaccard_join": jaccard_join.sql,
    "op3_substring_dedup": substring_dedup.sql,
    "op5_quality_rules": quality_rules.sql,
    "op6_pivot_index": pivot_index.sql,
    "op8_source_mixing": mixing.sql,
}
