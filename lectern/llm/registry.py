"""The subpackage's queries and their DuckDB SQL."""

from __future__ import annotations

from lectern.llm import conversations, decontaminate, hard_negatives, jaccard, lm_score, near_vectors, packing, pii, quality, secret_scan, substring_dedup, token_files, url_filter


def queries() -> dict:
    return {"op1_url_filter": url_filter.op1_url_filter, "op2_quality": quality.op2_quality, "op3_substring_dedup": substring_dedup.op3_substring_dedup, "op4_near_vectors": near_vectors.op4_near_vectors, "op5_pii": pii.op5_pii, "op6_jaccard": jaccard.op6_jaccard, "op7_decontaminate": decontaminate.op7_decontaminate, "op8_packing": packing.op8_packing, "op9_secrets": secret_scan.op9_secrets, "op10_lm_score": lm_score.op10_lm_score, "op11_conversations": conversations.op11_conversations, "op12_hard_negatives": hard_negatives.op12_hard_negatives, "op13_token_files": token_files.op13_token_files}


def oracle_sql() -> dict[str, str]:
    return {"op11_conversations": conversations.SQL, "op12_hard_negatives": hard_negatives.SQL}
