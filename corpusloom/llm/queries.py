"""The training-data queries and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from corpusloom.llm import chat, codes, decontam, fim, langid, neardup, overlap, pieces, pii, quality, secrets, sharding, topk

QUERIES = {
    "op1_hash_tree_sharding": sharding.op1_hash_tree_sharding,
    "op2_quality_classifier": quality.op2_quality_classifier,
    "op3_sampled_pieces": pieces.op3_sampled_pieces,
    "op4_secret_scan": secrets.op4_secret_scan,
    "op5_topk_inner_product": topk.op5_topk_inner_product,
    "op6_chat_formatting": chat.op6_chat_formatting,
    "op7_simhash_neardup": neardup.op7_simhash_neardup,
    "op8_language_id": langid.op8_language_id,
    "op9_benchmark_decontamination": decontam.op9_benchmark_decontamination,
    "op10_pii_weak_supervision": pii.op10_pii_weak_supervision,
    "op11_jaccard_join": overlap.op11_jaccard_join,
    "op12_fill_in_middle": fim.op12_fill_in_middle,
    "op13_vector_codes": codes.op13_vector_codes,
}

ORACLE_SQL = {
    "op1_hash_tree_sharding": sharding.oracle(),
    "op4_secret_scan": secrets.oracle(),
    "op5_topk_inner_product": topk.oracle(),
    "op6_chat_formatting": chat.oracle(),
    "op9_benchmark_decontamination": decontam.oracle(),
    "op11_jaccard_join": overlap.oracle(),
    "op12_fill_in_middle": fim.oracle(),
    "op13_vector_codes": codes.oracle(),
}
