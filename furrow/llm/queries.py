"""The text operators over the given tables, and SQL that must give the same rows where SQL can."""

from __future__ import annotations

from furrow.llm import (
    bpe_segments,
    containment,
    filter_audit,
    html_crf,
    language_cnn,
    ngram_join,
    pii_boost,
    quality_gam,
    quality_rules,
    simhash_index,
    slot_shards,
    token_planes,
    whitening,
)

QUERIES = {
    "op1_token_planes": token_planes.op1,
    "op2_pii_boosting": pii_boost.op2,
    "op3_html_crf": html_crf.op3,
    "op4_bpe_segment_tree": bpe_segments.op4,
    "op5_virtual_slots": slot_shards.op5,
    "op6_quality_rules": quality_rules.op6,
    "op7_byte_cnn": language_cnn.op7,
    "op8_containment_search": containment.op8,
    "op9_additive_model": quality_gam.op9,
    "op10_ngram_join": ngram_join.op10,
    "op11_simhash_index": simhash_index.op11,
    "op12_embedding_whitening": whitening.op12,
    "op13_filter_audit": filter_audit.op13,
}
ORACLES = {
    "op6_quality_rules": quality_rules.sql(),
    "op8_containment_search": containment.sql(),
    "op10_ngram_join": ngram_join.sql(),
    "op13_filter_audit": filter_audit.sql(),
}
