"""The queries of this subpackage and their SQL, which __spark_entry__ adds when the subpackage is there."""

from __future__ import annotations

from . import chat, embeddings, media, mixing, neardup, paragraphs, pieces, sharding, suffix, toxicity


def queries() -> dict:
    return {
        "op1_suffix_array": suffix.op1,
        "op2_sharding": sharding.op2,
        "op3_sentencepiece": pieces.op3,
        "op4_embedding_near_dedup": embeddings.op4,
        "op5_chat_format": chat.op5,
        "op6_substring_dedup": paragraphs.op6,
        "op7_prob_minhash": neardup.op7,
        "op8_ogg_media": media.op8,
        "op9_toxicity": toxicity.op9,
        "op10_mixing": mixing.op10,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_chat_format": chat.OP5_SQL, "op10_mixing": mixing.OP10_SQL}
