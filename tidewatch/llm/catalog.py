"""Queries of the corpus operators and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from tidewatch.llm import (alignment, embeddings, mixing, passages, pieces, resample, secretscan, simhash, substrings,
                           tokencount, topk, toxicity, zipquality)

QUERIES = {
    "op1_topk_search": topk.op1_topk_search,
    "op2_mix_sources": mixing.op2_mix_sources,
    "op3_token_counts": tokencount.op3_token_counts,
    "op4_simhash": simhash.op4_simhash,
    "op5_embeddings": embeddings.op5_embeddings,
    "op6_pieces": pieces.op6_pieces,
    "op7_passages": passages.op7_passages,
    "op8_secrets": secretscan.op8_secrets,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_suffix_dedup": substrings.op10_suffix_dedup,
    "op11_token_alignment": alignment.op11_token_alignment,
    "op12_importance_resample": resample.op12_importance_resample,
    "op13_compression_quality": zipquality.op13_compression_quality,
}

ORACLE_SQL = {
    "op1_topk_search": topk.ORACLE_SQL,
    "op2_mix_sources": mixing.ORACLE_SQL,
    "op5_embeddings": embeddings.ORACLE_SQL,
}
