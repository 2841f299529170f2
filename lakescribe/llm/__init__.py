"""Operators of training-data pipelines. Nothing else in the library imports this folder."""

from __future__ import annotations

from . import hard_negatives, html_extract, language_id, media, merge_rounds, packing, prefix_bpe, pu_quality, quality_rules, simhash, token_counts, toxicity, whitening


def queries() -> dict:
    return {
        "op1_token_counts": token_counts.op1_token_counts,
        "op2_simhash": simhash.op2_simhash,
        "op3_quality_rules": quality_rules.op3_quality_rules,
        "op4_byte_bpe": prefix_bpe.op4_byte_bpe,
        "op5_best_fit_packing": packing.op5_best_fit_packing,
        "op6_pu_quality": pu_quality.op6_pu_quality,
        "op7_language_id": language_id.op7_language_id,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_lossless_webp": media.op9_lossless_webp,
        "op10_html_extraction": html_extract.op10_html_extraction,
        "op11_sentencepiece": merge_rounds.op11_sentencepiece,
        "op12_whitening": whitening.op12_whitening,
        "op13_hard_negatives": hard_negatives.op13_hard_negatives,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_quality_rules": quality_rules.ORACLE_SQL}
