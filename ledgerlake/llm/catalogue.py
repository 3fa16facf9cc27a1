"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from ledgerlake.llm import factors, licences, linededup, mixing, nearcopies, negatives, packing, quality, repair, secrets, sharding, topk, toxicity

QUERIES = {
    "op1_line_dedup": linededup.op1_line_dedup,
    "op2_licences": licences.op2_licences,
    "op3_packing": packing.op3_packing,
    "op4_quality": quality.op4_quality,
    "op5_topk": topk.op5_topk,
    "op6_sharding": sharding.op6_sharding,
    "op7_near_copies": nearcopies.op7_near_copies,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_mixing": mixing.op9_mixing,
    "op10_secrets": secrets.op10_secrets,
    "op11_negatives": negatives.op11_negatives,
    "op12_factors": factors.op12_factors,
    "op13_repair": repair.op13_repair,
}

SQL = {
    "op5_topk": topk.SQL,
    "op9_mixing": mixing.SQL,
    "op11_negatives": negatives.SQL,
}
