"""Queries of this subpackage: ``QUERIES[name](spark, sf_dir)`` and their DuckDB texts in ``ORACLE``."""

from __future__ import annotations

from contactlens.llm import (alignment, chat_format, chunk_dedup, cover_tree, divergence, embedding_dedup, exact_dedup,
                             lattice, license_scan, line_dedup, mixing, ngram_join, quality)

QUERIES = {
    "op1_pstable_near_dedup": embedding_dedup.query,
    "op2_cover_tree_top_k": cover_tree.query,
    "op3_ngram_jaccard_join": ngram_join.query,
    "op4_fuzzy_line_dedup": line_dedup.query,
    "op5_license_scan": license_scan.query,
    "op6_importance_resampling": quality.query,
    "op7_chat_format": chat_format.query,
    "op8_lattice_samples": lattice.query,
    "op9_chunk_dedup": chunk_dedup.query,
    "op10_poisson_mixing": mixing.query,
    "op11_source_divergence": divergence.query,
    "op12_streaming_exact_dedup": exact_dedup.query,
    "op13_token_alignment": alignment.query,
}
ORACLE = {
    "op1_pstable_near_dedup": embedding_dedup.SQL,
    "op2_cover_tree_top_k": cover_tree.SQL,
    "op7_chat_format": chat_format.SQL,
    "op10_poisson_mixing": mixing.SQL,
    "op11_source_divergence": divergence.SQL,
    "op12_streaming_exact_dedup": exact_dedup.SQL,
}
