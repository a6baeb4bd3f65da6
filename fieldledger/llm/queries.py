"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from fieldledger.llm import (
    alignment,
    byte_bpe,
    conversations,
    mixing,
    quality_classifier,
    quality_rules,
    secrets,
    sharding,
    simhash,
    token_counts,
    toxicity,
    url_filter,
    webp,
)

QUERIES = {
    "op1_webp": webp.query,
    "op2_token_counts": token_counts.query,
    "op3_mixing": mixing.query,
    "op4_quality_classifier": quality_classifier.query,
    "op5_url_filter": url_filter.query,
    "op6_byte_bpe": byte_bpe.query,
    "op7_simhash": simhash.query,
    "op8_quality_rules": quality_rules.query,
    "op9_toxicity": toxicity.query,
    "op10_secrets": secrets.query,
    "op11_alignment": alignment.query,
    "op12_conversations": conversations.query,
    "op13_sharding": sharding.query,
}

ORACLE_SQL = {"op5_url_filter": url_filter.oracle()}
