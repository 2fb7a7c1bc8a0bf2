"""The corpus operators' queries, and SQL for those that SQL can express."""

from __future__ import annotations

from lantern.llm import bpe, langid, media, neardup, packing, pii, quality, repeats, topk, toxicity

QUERIES = {
    "op1_topk": topk.op1_topk,
    "op2_pii": pii.op2_pii,
    "op3_langid": langid.op3_langid,
    "op4_minhash": neardup.op4_minhash,
    "op5_bpe": bpe.op5_bpe,
    "op6_flac": media.op6_flac,
    "op7_packing": packing.op7_packing,
    "op8_suffix": repeats.op8_suffix,
    "op9_quality": quality.op9_quality,
    "op10_toxicity": toxicity.op10_toxicity,
}
ORACLES: dict[str, str] = {
    "op1_topk": topk.ORACLE,
    "op4_minhash": neardup.ORACLE,
    "op8_suffix": repeats.ORACLE,
}
