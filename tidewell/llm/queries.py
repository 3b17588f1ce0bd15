"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from tidewell.llm import bpe, chat, decontam, embed_dedup, langid, mixing, negatives, quality, runs, sharding, simhash, topk, urls

QUERIES = {
    "op1_exact_topk": topk.op1_exact_topk,
    "op2_language_id": langid.op2_language_id,
    "op3_embedding_dedup": embed_dedup.op3_embedding_dedup,
    "op4_quality": quality.op4_quality,
    "op5_chat": chat.op5_chat,
    "op6_mixing": mixing.op6_mixing,
    "op7_sharding": sharding.op7_sharding,
    "op8_bpe": bpe.op8_bpe,
    "op9_url_filter": urls.op9_url_filter,
    "op10_simhash": simhash.op10_simhash,
    "op11_hard_negatives": negatives.op11_hard_negatives,
    "op12_decontaminate": decontam.op12_decontaminate,
    "op13_periodic_runs": runs.op13_periodic_runs,
}

SQL = {
    "op1_exact_topk": topk.OP1_SQL,
    "op3_embedding_dedup": embed_dedup.OP3_SQL,
    "op5_chat": chat.OP5_SQL,
    "op9_url_filter": urls.OP9_SQL,
    "op11_hard_negatives": negatives.OP11_SQL,
    "op12_decontaminate": decontam.OP12_SQL,
}
