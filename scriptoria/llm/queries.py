"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from scriptoria.llm import audit, hnsw, katz, language, mixing, packing, pages, quality, secrets, simhash, sketches, suffixes, whitening

QUERIES = {
    "op1_simhash_dedup": simhash.op1_simhash_dedup,
    "op2_secret_scan": secrets.op2_secret_scan,
    "op3_page_text": pages.op3_page_text,
    "op4_best_fit_packing": packing.op4_best_fit_packing,
    "op5_suffix_dedup": suffixes.op5_suffix_dedup,
    "op6_pareto_mixing": mixing.op6_pareto_mixing,
    "op7_katz_scores": katz.op7_katz_scores,
    "op8_quality_lines": quality.op8_quality_lines,
    "op9_hnsw_dedup": hnsw.op9_hnsw_dedup,
    "op10_language_id": language.op10_language_id,
    "op11_filter_audit": audit.op11_filter_audit,
    "op12_embedding_whitening": whitening.op12_embedding_whitening,
    "op13_document_fingerprints": sketches.op13_document_fingerprints,
}
ORACLES = {
    "op6_pareto_mixing": mixing.ORACLE,
    "op8_quality_lines": quality.ORACLE,
    "op11_filter_audit": audit.ORACLE,
}
