"""Queries of this subpackage and the SQL that states some of them."""

from __future__ import annotations

from . import decontamination, lmscore, minhash, mixing, multiindex, secretscan, sharding, suffixes, tokencount, toxicity

QUERIES = {
    "op1_embedding_near_dedup": multiindex.query,
    "op2_suffix_array_dedup": suffixes.query,
    "op3_secret_scan": secretscan.query,
    "op4_minhash_near_dedup": minhash.query,
    "op5_lm_scoring": lmscore.query,
    "op6_benchmark_decontamination": decontamination.query,
    "op7_token_counts": tokencount.query,
    "op8_sharding": sharding.query,
    "op9_toxicity": toxicity.query,
    "op10_mixing": mixing.query,
}

SQL = {
    "op1_embedding_near_dedup": multiindex.SQL,
    "op2_suffix_array_dedup": suffixes.SQL,
    "op3_secret_scan": secretscan.SQL,
    "op6_benchmark_decontamination": decontamination.SQL,
}
