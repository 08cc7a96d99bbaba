"""The registered queries of the corpus operators and their reference SQL."""

from __future__ import annotations

from lumenframe.llm import bpe, chat, html_extract, line_dedup, mixing, near_dedup, pii, quality, rp_forest, suffix_dedup

QUERIES = {
    "op1_html_extract": html_extract.query,
    "op2_rp_forest": rp_forest.query,
    "op3_mix_sources": mixing.query,
    "op4_near_dedup": near_dedup.query,
    "op5_byte_bpe": bpe.query,
    "op6_pii_crf": pii.query,
    "op7_quality_rules": quality.query,
    "op8_chat_format": chat.query,
    "op9_suffix_dedup": suffix_dedup.query,
    "op10_line_dedup": line_dedup.query,
}

ORACLES = {
    "op3_mix_sources": mixing.oracle(),
    "op7_quality_rules": quality.oracle(),
    "op8_chat_format": chat.oracle(),
}
