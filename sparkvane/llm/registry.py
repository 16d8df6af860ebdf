"""Queries of this folder and their DuckDB SQL."""

from __future__ import annotations

from sparkvane.llm import asof, chat, decontamination, fingerprints, jaccard_join, line_runs, mixing, repeats, secrets, sharding, toxicity, trie, url_filters


def queries() -> dict:
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_chat_formatting": chat.op2_chat_formatting,
        "op3_suffix_dedup": repeats.op3_suffix_dedup,
        "op4_mixing": mixing.op4_mixing,
        "op5_secret_scans": secrets.op5_secret_scans,
        "op6_fingerprints": fingerprints.op6_fingerprints,
        "op7_url_filters": url_filters.op7_url_filters,
        "op8_jaccard_join": jaccard_join.op8_jaccard_join,
        "op9_sharding": sharding.op9_sharding,
        "op10_decontamination": decontamination.op10_decontamination,
        "op11_asof": asof.op11_asof,
        "op12_line_dedup": line_runs.op12_line_dedup,
        "op13_prefix_trie": trie.op13_prefix_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {"op11_asof": asof.OP11_SQL, "op12_line_dedup": line_runs.OP12_SQL, "op13_prefix_trie": trie.OP13_SQL, "op2_chat_formatting": chat.OP2_SQL, "op4_mixing": mixing.OP4_SQL, "op7_url_filters": url_filters.OP7_SQL, "op9_sharding": sharding.OP9_SQL}
