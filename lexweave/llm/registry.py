"""Queries of the training-data operators and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from . import chat, language, lexical, line_dedup, mixing, near_join, pieces, pii, quality, secret_scan, sharding, trie, vectors

QUERIES = {
    "op1_near_join": near_join.op1_near_join,
    "op2_pieces": pieces.op2_pieces,
    "op3_pii": pii.op3_pii,
    "op4_language": language.op4_language,
    "op5_quality": quality.op5_quality,
    "op6_secrets": secret_scan.op6_secrets,
    "op7_chat": chat.op7_chat,
    "op8_mix": mixing.op8_mix,
    "op9_shard": sharding.op9_shard,
    "op10_vectors": vectors.op10_vectors,
    "op11_search": lexical.op11_search,
    "op12_trie": trie.op12_trie,
    "op13_lines": line_dedup.op13_lines,
}

SQL = {
    "op1_near_join": near_join.SQL,
    "op3_pii": pii.SQL,
    "op6_secrets": secret_scan.SQL,
    "op7_chat": chat.SQL,
    "op8_mix": mixing.SQL,
    "op10_vectors": vectors.SQL,
    "op11_search": lexical.SQL,
    "op12_trie": trie.SQL,
    "op13_lines": line_dedup.SQL,
}
