"""Queries of this subpackage, one for each operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe, collocations, filter_audit, language_id, line_dedup, minhash_dedup, mixing, quality, secrets, substring_dedup, token_counts, topk, toxicity

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_minhash_dedup": minhash_dedup.op2_minhash_dedup,
    "op3_exact_topk": topk.op3_exact_topk,
    "op4_mix_sources": mixing.op4_mix_sources,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_bpe": bpe.op6_bpe,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_token_counts": token_counts.op8_token_counts,
    "op9_secret_scan": secrets.op9_secret_scan,
    "op10_quality_rules": quality.op10_quality_rules,
    "op11_collocations": collocations.op11_collocations,
    "op12_language_id": language_id.op12_language_id,
    "op13_filter_audit": filter_audit.op13_filter_audit,
}
ORACLE_SQL = {"op3_exact_topk": topk.ORACLE_SQL, "op4_mix_sources": mixing.ORACLE_SQL, "op10_quality_rules": quality.ORACLE_SQL, "op11_collocations": collocations.ORACLE_SQL, "op13_filter_audit": filter_audit.ORACLE_SQL}
