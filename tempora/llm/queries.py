"""The queries of this package, by name, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from tempora.llm import byte_bpe, decontamination, jaccard_join, line_dedup, pii, quality_classifier, quality_rules, sharding, toxicity, url_filters

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_pii": pii.op4_pii,
    "op5_url_filters": url_filters.op5_url_filters,
    "op6_jaccard_join": jaccard_join.op6_jaccard_join,
    "op7_decontamination": decontamination.op7_decontamination,
    "op8_quality_classifier": quality_classifier.op8_quality_classifier,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_byte_bpe": byte_bpe.op10_byte_bpe,
}

ORACLE_SQL = {
    "op3_quality_rules": quality_rules.oracle(),
    "op5_url_filters": url_filters.oracle(),
    "op6_jaccard_join": jaccard_join.ORACLE,
    "op7_decontamination": decontamination.ORACLE,
    "op9_line_dedup": line_dedup.ORACLE,
}
