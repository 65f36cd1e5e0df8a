"""The corpus queries and, where SQL can express them, the DuckDB statements with the same rows."""

from __future__ import annotations

from tessel.llm import bpe, embeddings, hmm, langid, line_dedup, packing, pii, simhash, topk, warc

QUERIES = {
    "op1_language_id": langid.query,
    "op2_packing": packing.query,
    "op3_bpe": bpe.query,
    "op4_line_dedup": line_dedup.query,
    "op5_exact_top_k": topk.query,
    "op6_hmm_score": hmm.query,
    "op7_simhash_near_dedup": simhash.query,
    "op8_embedding_near_dedup": embeddings.query,
    "op9_pii": pii.query,
    "op10_warc": warc.query,
}

ORACLE_SQL = {
    "op4_line_dedup": line_dedup.SQL,
    "op5_exact_top_k": topk.SQL,
    "op8_embedding_near_dedup": embeddings.SQL,
    "op10_warc": warc.SQL,
}
