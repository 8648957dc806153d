"""The queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

from . import bpe, gru_lm, language_id, mixing, sharding, simhash, spotsigs, suffix_dedup, token_counts, topk_search
from .oracle import SQL


def queries() -> dict:
    found = [
        token_counts.op1_token_counts,
        bpe.op2_bpe,
        topk_search.op3_topk_search,
        sharding.op4_sharding,
        mixing.op5_mixing,
        suffix_dedup.op6_suffix_dedup,
        simhash.op7_simhash,
        gru_lm.op8_gru_lm,
        spotsigs.op9_spotsigs,
        language_id.op10_language_id,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
