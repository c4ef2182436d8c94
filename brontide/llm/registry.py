"""Queries of this subpackage and their oracles."""

from __future__ import annotations

from brontide.llm import bpe, decontaminate, jaccard_join, license_scan, ngram_lm, quality, substring_dedup, toxicity, url_filter, wavelet


def queries() -> dict:
    return {
        "op1_deleted_interpolation": ngram_lm.op1_deleted_interpolation,
        "op2_quality_rules": quality.op2_quality_rules,
        "op3_substring_dedup": substring_dedup.op3_substring_dedup,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_license_scan": license_scan.op5_license_scan,
        "op6_wavelet_files": wavelet.op6_wavelet_files,
        "op7_decontaminate": decontaminate.op7_decontaminate,
        "op8_jaccard_join": jaccard_join.op8_jaccard_join,
        "op9_url_filter": url_filter.op9_url_filter,
        "op10_byte_bpe": bpe.op10_byte_bpe,
    }


def oracle_sql() -> dict[str, str]:
    return {"op9_url_filter": url_filter.oracle_sql()}
