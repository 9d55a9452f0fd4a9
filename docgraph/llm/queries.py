"""Queries of the training-data operators, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, conversation_repair, decontamination, embedding_dedup, minhash_dedup, mixing, pii, quality, suffix_dedup, token_counts, toxicity, url_filters, whitening

QUERIES = {
    "op1_url_filters": url_filters.op1_url_filters,
    "op2_mixing": mixing.op2_mixing,
    "op3_minhash_dedup": minhash_dedup.op3_minhash_dedup,
    "op4_embedding_dedup": embedding_dedup.op4_embedding_dedup,
    "op5_token_counts": token_counts.op5_token_counts,
    "op6_quality": quality.op6_quality,
    "op7_pii": pii.op7_pii,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
    "op10_decontamination": decontamination.op10_decontamination,
    "op11_conversation_repair": conversation_repair.op11_conversation_repair,
    "op12_whitening": whitening.op12_whitening,
    "op13_bpe": bpe.op13_bpe,
}
ORACLE_SQL = {
    "op1_url_filters": url_filters.OP1_SQL,
    "op2_mixing": mixing.OP2_SQL,
    "op5_token_counts": token_counts.OP5_SQL,
    "op11_conversation_repair": conversation_repair.OP11_SQL,
}
