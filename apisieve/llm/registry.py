"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from . import ann, exact_dedup, lm_scoring, mixing, near_dedup, packing, quality, secret_scan, token_counts, token_output

QUERIES = {
    "op1_ann": ann.op1_ann,
    "op2_token_output": token_output.op2_token_output,
    "op3_secret_scan": secret_scan.op3_secret_scan,
    "op4_mixing": mixing.op4_mixing,
    "op5_lm_scoring": lm_scoring.op5_lm_scoring,
    "op6_quality_classifier": quality.op6_quality_classifier,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_near_dedup": near_dedup.op8_near_dedup,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_best_fit_packing": packing.op10_best_fit_packing,
}

ORACLES = {
    "op4_mixing": mixing.ORACLE_SQL,
    "op7_token_counts": token_counts.ORACLE_SQL,
    "op9_exact_dedup": exact_dedup.ORACLE_SQL,
}
