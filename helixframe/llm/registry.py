"""Queries of this folder and their SQL, for the entry module."""

from __future__ import annotations

from . import decontaminate, divergence, langid, licenses, linededup, mixing, ngram_join, sharding, spelling, tokenids, topk, toxicity, warc

QUERIES = {
    "op1_linededup": linededup.op1_linededup,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_mixing": mixing.op3_mixing,
    "op4_warc": warc.op4_warc,
    "op5_langid": langid.op5_langid,
    "op6_tokens": tokenids.op6_tokens,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_licenses": licenses.op8_licenses,
    "op9_topk": topk.op9_topk,
    "op10_ngram_join": ngram_join.op10_ngram_join,
    "op11_sharding": sharding.op11_sharding,
    "op12_spelling": spelling.op12_spelling,
    "op13_divergence": divergence.op13_divergence,
    "dedup_lines": linededup.dedup_lines,
}
ORACLES = {
    "op3_mixing": mixing.ORACLE,
    "op4_warc": warc.ORACLE,
    "op8_licenses": licenses.ORACLE,
    "op9_topk": topk.ORACLE,
    "op11_sharding": sharding.ORACLE,
    "op12_spelling": spelling.ORACLE,
    "op13_divergence": divergence.ORACLE,
}
