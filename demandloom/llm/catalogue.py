"""The corpus queries and their oracle SQL."""

from __future__ import annotations

from demandloom.llm import (decontamination, filter_audit, line_dedup, lm_scoring, neighbours, packing, periodic_runs, quality,
                            quality_rules, secrets, simhash, substring_dedup, toxicity)


def queries() -> dict:
    return {
        "op1_line_dedup": line_dedup.op1_line_dedup,
        "op2_quality": quality.op2_quality,
        "op3_simhash": simhash.op3_simhash,
        "op4_substring_dedup": substring_dedup.op4_substring_dedup,
        "op5_lm_scoring": lm_scoring.op5_lm_scoring,
        "op6_neighbours": neighbours.op6_neighbours,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_packing": packing.op8_packing,
        "op9_secrets": secrets.op9_secrets,
        "op10_decontamination": decontamination.op10_decontamination,
        "op11_filter_audit": filter_audit.op11_filter_audit,
        "op12_quality_rules": quality_rules.op12_quality_rules,
        "op13_periodic_runs": periodic_runs.op13_periodic_runs,
    }


def oracles() -> dict:
    return {
        "op1_line_dedup": line_dedup.ORACLE, "op9_secrets": secrets.ORACLE, "op11_filter_audit": filter_audit.ORACLE, "op12_quality_rules": quality_rules.ORACLE}
