"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pagewright.llm import chat, language, licenses, media, neardup, negatives, packing, pieces, quality, substrings, token_store, warc, whitening


def queries() -> dict:
    return {
        "op1_quality_rules": quality.op1_quality_rules,
        "quality_ablations": quality.quality_ablations,
        "op2_token_store": token_store.op2_token_store,
        "op3_best_fit_packing": packing.op3_best_fit_packing,
        "op4_license_scan": licenses.op4_license_scan,
        "op5_sentencepiece": pieces.op5_sentencepiece,
        "op6_substring_dedup": substrings.op6_substring_dedup,
        "op7_chat_formatting": chat.op7_chat_formatting,
        "op8_warc_bundles": warc.op8_warc_bundles,
        "op9_minhash_near_dedup": neardup.op9_minhash_near_dedup,
        "op10_media_columns": media.op10_media_columns,
        "op11_embedding_whitening": whitening.op11_embedding_whitening,
        "op12_language_id": language.op12_language_id,
        "op13_hard_negatives": negatives.op13_hard_negatives,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": quality.ORACLE,
        "quality_ablations": quality.ABLATIONS_ORACLE,
        "op4_license_scan": licenses.ORACLE,
        "op6_substring_dedup": substrings.ORACLE,
        "op7_chat_formatting": chat.ORACLE,
        "op8_warc_bundles": warc.ORACLE,
        "op9_minhash_near_dedup": neardup.ORACLE,
        "op13_hard_negatives": negatives.ORACLE,
    }
