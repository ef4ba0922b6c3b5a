"""Queries of this subpackage and their DuckDB oracles, by name."""

from __future__ import annotations

from docloom.llm import bpe, decontaminate, language_id, licenses, near_dedup, periodic_runs, pii, quality_rules, substring_dedup, token_alignment, token_counts, toxicity, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_near_dedup": near_dedup.op2_near_dedup,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_token_counts": token_counts.op4_token_counts,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_quality_rules": quality_rules.op6_quality_rules,
    "op7_substring_dedup": substring_dedup.op7_substring_dedup,
    "op8_license_scan": licenses.op8_license_scan,
    "op9_pii": pii.op9_pii,
    "op10_bpe": bpe.op10_bpe,
    "op11_periodic_runs": periodic_runs.op11_periodic_runs,
    "op12_token_alignment": token_alignment.op12_token_alignment,
    "op13_language_id": language_id.op13_language_id,
}

ORACLES: dict[str, str] = {"op1_warc": warc.ORACLE, "op7_substring_dedup": substring_dedup.ORACLE, "op8_license_scan": licenses.oracle()}
