"""Registered queries of the training-text operators."""

from __future__ import annotations

from tessera.llm import context_mixing, exact_dedup, language_id, line_dedup, merkle, minhash, packing, phrases, quality_classifier, quality_rules, sentencepiece_sampling, suffix_dedup, toxicity

QUERIES = {
    "op1_language_id": language_id.op1_language_id,
    "op2_sentencepiece": sentencepiece_sampling.op2_sentencepiece,
    "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
    "op4_quality_rules": quality_rules.op4_quality_rules,
    "op5_quality_classifier": quality_classifier.op5_quality_classifier,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_packing": packing.op8_packing,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_minhash": minhash.op10_minhash,
    "op11_phrases": phrases.op11_phrases,
    "op12_lm_scoring": context_mixing.op12_lm_scoring,
    "op13_merkle": merkle.op13_merkle,
}

ORACLE_SQL = {"op4_quality_rules": quality_rules.ORACLE, "op6_exact_dedup": exact_dedup.ORACLE, "op11_phrases": phrases.ORACLE, "op13_merkle": merkle.ORACLE}
