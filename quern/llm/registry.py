"""The queries of this package and, where SQL expresses them, their DuckDB counterparts."""

from __future__ import annotations

from quern.llm import decontaminate, embedding_dedup, html_extract, language_id, language_model, near_dedup, packing, pii, secret_scan, toxicity

QUERIES = {
    "op1_language_id": language_id.op1_language_id,
    "op2_near_dedup": near_dedup.op2_near_dedup,
    "op3_html_extract": html_extract.op3_html_extract,
    "op4_lm_score": language_model.op4_lm_score,
    "op5_secret_scan": secret_scan.op5_secret_scan,
    "op6_pii": pii.op6_pii,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_embedding_dedup": embedding_dedup.op9_embedding_dedup,
    "op10_packing": packing.op10_packing,
}

ORACLES = {"op2_near_dedup": near_dedup.ORACLE, "op8_decontaminate": decontaminate.ORACLE, "op9_embedding_dedup": embedding_dedup.ORACLE}
