"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import byte_bpe, cube_mix, feistel_shard, fim_cuts, fm_quality, hard_negatives, html_wrappers, pii_boost, quality_rules, secret_owners, simhash_dedup, token_cache, topk_search

QUERIES = {
    "op1_simhash_dedup": simhash_dedup.op1,
    "op2_cube_mix": cube_mix.op2,
    "op3_quality_rules": quality_rules.op3,
    "op4_token_counts": token_cache.op4,
    "op5_quality_classifier": fm_quality.op5,
    "op6_pii": pii_boost.op6,
    "op7_topk_search": topk_search.op7,
    "op8_feistel_shards": feistel_shard.op8,
    "op9_html_extraction": html_wrappers.op9,
    "op10_byte_bpe": byte_bpe.op10,
    "op11_hard_negatives": hard_negatives.op11,
    "op12_secret_scan": secret_owners.op12,
    "op13_fill_in_middle": fim_cuts.op13,
}

ORACLE_SQL = {
    "op3_quality_rules": quality_rules.OP3_SQL,
    "op7_topk_search": topk_search.OP7_SQL,
    "op11_hard_negatives": hard_negatives.OP11_SQL,
    "op12_secret_scan": secret_owners.OP12_SQL,
    "op13_fill_in_middle": fim_cuts.OP13_SQL,
}
