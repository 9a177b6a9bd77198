"""All queries of the subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from tracklane.llm import q_centroids, q_chat, q_embeddup, q_langid, q_licenses, q_mixing, q_neardup, q_packing, q_pitmanyor, q_quality, q_secrets, q_toxicity


def queries() -> dict:
    return {
        "op1_secret_scans": q_secrets.op1_secret_scans,
        "op2_mix_sources": q_mixing.op2_mix_sources,
        "op3_pack_sequences": q_packing.op3_pack_sequences,
        "op4_minhash_neardup": q_neardup.op4_minhash_neardup,
        "op5_lm_scoring": q_pitmanyor.op5_lm_scoring,
        "op6_toxicity": q_toxicity.op6_toxicity,
        "op7_license_scans": q_licenses.op7_license_scans,
        "op8_embedding_neardup": q_embeddup.op8_embedding_neardup,
        "op9_quality_rules": q_quality.op9_quality_rules,
        "op10_language_id": q_langid.op10_language_id,
        "op11_chat_formatting": q_chat.op11_chat_formatting,
        "op12_centroid_clustering": q_centroids.op12_centroid_clustering,
        "quality_rules_low_limit": q_quality.quality_rules_low_limit,
        "chat_formatting_layouts": q_chat.chat_formatting_layouts,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_mix_sources": q_mixing.SQL,
        "op4_minhash_neardup": q_neardup.SQL,
        "op7_license_scans": q_licenses.sql(),
        "op8_embedding_neardup": q_embeddup.SQL,
        "op9_quality_rules": q_quality.SQL,
        "op11_chat_formatting": q_chat.SQL,
        "op12_centroid_clustering": q_centroids.sql(),
        "quality_rules_low_limit": q_quality.LOW_LIMIT_SQL,
        "chat_formatting_layouts": q_chat.LAYOUTS_SQL,
    }
