"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from . import alignment, ann, bpe, chat, divergence, language_id, minhash, packing, quality_classifier, quality_rules, sharding, suffix_dedup, url_filter


def queries() -> dict:
    return {
        "op1_quality_rules": quality_rules.op1_quality_rules,
        "op5_quality_classifier": quality_classifier.op5_quality_classifier,
        "op2_bpe": bpe.op2_bpe,
        "op7_ann": ann.op7_ann,
        "op3_minhash": minhash.op3_minhash,
        "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
        "op4_url_filter": url_filter.op4_url_filter,
        "op6_sharding": sharding.op6_sharding,
        "op8_chat_format": chat.op8_chat_format,
        "op9_packing": packing.op9_packing,
        "op13_language_id": language_id.op13_language_id,
        "op12_source_divergence": divergence.op12_source_divergence,
        "op11_alignment": alignment.op11_alignment,
    }


def oracle_sql() -> dict:
    return {"op1_quality_rules": quality_rules.op1_sql(), "op3_minhash": minhash.OP3_SQL, "op4_url_filter": url_filter.op4_sql(), "op8_chat_format": chat.OP8_SQL, "op10_suffix_dedup": suffix_dedup.OP10_SQL, "op12_source_divergence": divergence.OP12_SQL}
