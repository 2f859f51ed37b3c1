"""The corpus operators' queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import bpe, chat, langmix, packing, quality, simhash, token_store, toxicity, urls, vptree

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_urls": urls.op2_urls,
    "op3_packing": packing.op3_packing,
    "op4_simhash": simhash.op4_simhash,
    "op5_byte_bpe": bpe.op5_byte_bpe,
    "op6_chat": chat.op6_chat,
    "op7_token_files": token_store.op7_token_files,
    "op8_vptree": vptree.op8_vptree,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_language": langmix.op10_language,
}

ORACLES = {"op1_quality": quality.OP1_SQL, "op6_chat": chat.OP6_SQL}
