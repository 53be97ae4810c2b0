"""The training-data queries and the SQL that checks them."""

from __future__ import annotations

from . import chat, decontaminate, exact_dedup, language, line_dedup, minhash, mixing, oracles, prefix_trie, search, sharding, substring, toxicity, whitening


def queries() -> dict:
    return {
        "op1_fuse_exact_dedup": exact_dedup.op1_fuse_exact_dedup,
        "op2_fm_substring_dedup": substring.op2_fm_substring_dedup,
        "op3_chunked_line_dedup": line_dedup.op3_chunked_line_dedup,
        "op4_superminhash_near_dedup": minhash.op4_superminhash_near_dedup,
        "op5_byte_cnn_language": language.op5_byte_cnn_language,
        "op6_reply_tree_chat": chat.op6_reply_tree_chat,
        "op7_weighted_mix": mixing.op7_weighted_mix,
        "op8_feistel_sharding": sharding.op8_feistel_sharding,
        "op9_simhash_decontamination": decontaminate.op9_simhash_decontamination,
        "op10_nnpu_toxicity": toxicity.op10_nnpu_toxicity,
        "op11_radix_prefix_trie": prefix_trie.op11_radix_prefix_trie,
        "op12_charpoly_whitening": whitening.op12_charpoly_whitening,
        "op13_pivot_top_k": search.op13_pivot_top_k,
    }


def oracle_sql() -> dict:
    return {k: v for k, v in oracles.SQL.items() if k in queries()}
