"""The subpackage's queries and their SQL."""

from __future__ import annotations

from . import context_tree, decontamination, exact_dedup, jaccard_join, language_id, merkle, minhash, packing, secret_scan, sharding, suffix_dedup, toxicity, vector_codes

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_packing": packing.op3_packing,
    "op4_sharding": sharding.op4_sharding,
    "op5_language_id": language_id.op5_language_id,
    "op6_secret_scan": secret_scan.op6_secret_scan,
    "op7_decontamination": decontamination.op7_decontamination,
    "op8_lm_scoring": context_tree.op8_lm_scoring,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_jaccard_join": jaccard_join.op10_jaccard_join,
    "op11_vector_codes": vector_codes.op11_vector_codes,
    "op12_minhash_near_dedup": minhash.op12_minhash_near_dedup,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
}
ORACLES = {
    "op2_exact_dedup": exact_dedup.ORACLE,
    "op7_decontamination": decontamination.ORACLE,
    "op11_vector_codes": vector_codes.ORACLE,
    "op13_merkle_manifest": merkle.ORACLE,
}
