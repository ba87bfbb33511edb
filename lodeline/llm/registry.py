"""Queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from . import chat, fingerprints, jaccard_join, licenses, line_dedup, mixing, pieces, search_index, token_files, toxicity

QUERIES = {
    "op1_mix_sources": mixing.query,
    "op2_ngram_jaccard": jaccard_join.query,
    "op3_chat_format": chat.query,
    "op4_sentencepiece": pieces.query,
    "op5_token_files": token_files.query,
    "op6_license_scan": licenses.query,
    "op7_toxicity": toxicity.query,
    "op8_line_dedup": line_dedup.query,
    "op9_bm25_search": search_index.query,
    "op10_fingerprints": fingerprints.query,
}
ORACLES = {
    "op1_mix_sources": mixing.ORACLE,
    "op3_chat_format": chat.ORACLE,
}
