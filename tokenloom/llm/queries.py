"""The registered query of each training-data operator, over its whole table."""

from __future__ import annotations

from tokenloom.llm import bpe_automaton, chat_format, html_extraction, line_dedup, lm_scoring, near_dedup, packing, quality_rules, simhash, toxicity
from tokenloom.llm._common import documents

QUERIES = {
    "op1_lm_scoring": lm_scoring.op1,
    "op2_quality_rules": quality_rules.op2,
    "op3_html_extraction": html_extraction.op3,
    "op4_bpe_automaton": bpe_automaton.op4,
    "op5_line_dedup": lambda spark, sf_dir: line_dedup.op5(spark, documents(spark, sf_dir)),
    "op6_best_fit_packing": packing.op6,
    "op7_tool_call_linking": chat_format.op7,
    "linked_tool_calls": chat_format.linked,
    "op8_simhash": lambda spark, sf_dir: simhash.op8(spark, documents(spark, sf_dir)),
    "op9_toxicity": toxicity.op9,
    "op10_near_dedup": lambda spark, sf_dir: near_dedup.op10(spark, documents(spark, sf_dir)),
}

ORACLES = {
    "op5_line_dedup": line_dedup.ORACLE,
    "op10_near_dedup": near_dedup.ORACLE,
    "op7_tool_call_linking": chat_format.ORACLE,
    "linked_tool_calls": chat_format.LINKED_ORACLE,
}
