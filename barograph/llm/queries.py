"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from barograph.llm import chat, jaccard, language, licenses, mixing, packing, suffixes, topk, urls, vectors

QUERIES = {
    "op1_best_fit_packing": packing.op1,
    "op2_ngram_jaccard_join": jaccard.op2,
    "op3_url_filter": urls.op3,
    "op4_chat_windows": chat.op4,
    "op5_exact_top_k": topk.op5,
    "op6_embedding_near_dedup": vectors.op6,
    "op7_license_scan": licenses.op7,
    "op8_language_id": language.op8,
    "op9_source_mixing": mixing.op9,
    "op10_suffix_dedup": suffixes.op10,
}
ORACLE_SQL = {
    "op3_url_filter": urls.OP3_SQL,
    "op5_exact_top_k": topk.OP5_SQL,
    "op6_embedding_near_dedup": vectors.OP6_SQL,
    "op9_source_mixing": mixing.OP9_SQL,
}
