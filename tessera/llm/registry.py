"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

import corpus_pipeline
from tessera.llm import bpe, decontam, divergence, langid, lexical, linededup, lm, minhash, packing, secrets, suffixes, topk, warc

QUERIES = {
    "pipeline": (corpus_pipeline.run, corpus_pipeline.ORACLE_SQL),
    "op1_topk": (topk.op1_topk, topk.OP1_SQL),
    "op2_suffix_dedup": (suffixes.op2_suffix_dedup, None),
    "op3_warc": (warc.op3_warc, warc.OP3_SQL),
    "op4_line_dedup": (linededup.op4_line_dedup, linededup.OP4_SQL),
    "op5_language_id": (langid.op5_language_id, None),
    "op6_secrets": (secrets.op6_secrets, None),
    "op7_decontaminate": (decontam.op7_decontaminate, None),
    "op8_near_duplicates": (minhash.op8_near_duplicates, minhash.OP8_SQL),
    "op9_lm_score": (lm.op9_lm_score, None),
    "op10_byte_bpe": (bpe.op10_byte_bpe, None),
    "op11_divergence": (divergence.op11_divergence, divergence.OP11_SQL),
    "op12_packing": (packing.op12_packing, None),
    "op13_lexical": (lexical.op13_lexical, lexical.OP13_SQL),
}


def queries() -> dict:
    return {name: query for name, (query, _) in QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
